"""gridweave: sparse-structure analytics and large-corpus jobs as Spark DataFrame programs."""
