"""driftgrid: movement and population analytics as Spark DataFrame transforms."""
