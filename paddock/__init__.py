"""Race-card analytics and large-corpus text operators built from Spark DataFrames."""
