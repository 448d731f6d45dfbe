"""Object-centric event logs on Spark: six DataFrames, validated and built."""
