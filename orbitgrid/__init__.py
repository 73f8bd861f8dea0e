"""Analytics over capture sessions, assets, meshes and telemetry, as Spark DataFrames."""
