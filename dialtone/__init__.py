"""dialtone: call-center performance analytics as Spark DataFrame operators.

Every operator takes DataFrames and parameters and returns a lazy DataFrame.
Nothing is collected to the driver except listings of bounded size (file names,
period labels of a pivoted report).
"""
