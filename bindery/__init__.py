"""Document knowledge engine built on Spark DataFrames.

Every operator is a plain function from DataFrame(s) or Column(s) to
DataFrame or Column; nothing runs until the caller writes or collects.
"""
