"""Omics and network tables on Spark, with training-data operators beside them."""
