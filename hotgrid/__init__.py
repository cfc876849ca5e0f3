"""hotgrid: spatio-temporal incident analytics as lazy Spark DataFrame operators."""
