"""sightline: answer-visibility analytics as Spark DataFrame operators."""
