"""Analytics of time-boxed bonus windows as Spark DataFrame stages."""
