"""Building blocks of expressions: rates, periods, row scopes, display formats.

These functions take and return Spark SQL text. A report has dozens of
expressions, and one text is one call into the JVM where a tree of Column
objects is hundreds; Catalyst sees the same plan. Values chosen by users never
go into texts: they are passed as literals by the operators.
"""
