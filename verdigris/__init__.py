"""Message-risk analytics and text-dataset processing on PySpark DataFrames."""
