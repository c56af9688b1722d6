"""Dense tensor fields as Spark DataFrames: declarative field operators, ticks, sensors and actuators."""
