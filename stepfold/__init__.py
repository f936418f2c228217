"""Event-state analytics on Spark: DataFrame-to-DataFrame operators over event-sourced, versioned data."""
