"""spate — a PySpark-native analytics library for disaster-related social-media posts.

Every public operator is a DataFrame -> DataFrame function (or a Column
expression builder).  Nothing in the library creates a session, collects
data-sized results to the driver, or runs per-row Python in the hot path.
"""

__version__ = "0.1.0"
