"""onomast: organization-name resolution and analytics on Spark DataFrames."""
