"""wayside: a PySpark analytics engine for local discovery.

Every operator takes DataFrames and returns DataFrames.  Nothing is collected
on the driver; requests, links and logs may be arbitrarily large.
"""

__version__ = "0.1.0"
