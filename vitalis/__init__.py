"""vitalis: a Spark-native cohort, feature and risk-model engine."""
