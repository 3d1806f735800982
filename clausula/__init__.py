"""clausula: paragraph and sentence segmentation as Spark column expressions."""
