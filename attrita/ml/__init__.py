"""pyspark.ml jobs: classifiers, segmentation, explanation."""
