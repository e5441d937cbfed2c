"""chromatile: raster colour segmentation and corpus preparation, expressed as Spark DataFrames."""
