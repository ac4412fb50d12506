"""mendlake: program-repair and training-data analytics as Spark DataFrame programs."""
