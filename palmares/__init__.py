"""palmares: participation and medal analytics as Spark DataFrame jobs."""
