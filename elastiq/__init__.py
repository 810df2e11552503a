"""Price-elasticity analytics over behavioural logs, written as Spark DataFrame operators."""
