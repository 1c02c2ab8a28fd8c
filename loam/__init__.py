"""loam: spatio-temporal presence-only analytics and training-data operators on PySpark."""
