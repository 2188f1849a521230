"""corvane: DataFrame operators for building and evaluating labelled text sets on Spark."""
