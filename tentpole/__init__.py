"""tentpole: event-listing integration and search on Spark."""
