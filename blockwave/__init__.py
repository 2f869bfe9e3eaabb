"""Signal and video analytics on Spark: frames, blocks, coefficients, packets and rate-distortion points as DataFrames."""
