"""The catalog of pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The pictures of the catalog in its order (id, English title and category, difficulty, minutes).
ROWS = (
    ("aurora-lake", "Northern Lake", "Nature", "Средне", 42),
    ("quiet-fox", "Quiet Fox", "Animals", "Легко", 28),
    ("botanica", "Botanica No. 7", "Flowers", "Легко", 24),
    ("blue-coast", "Blue Coast", "Travel", "Средне", 36),
    ("midnight-city", "Midnight City", "Architecture", "Сложно", 55),
    ("peonies", "Peonies in a Vase", "Flowers", "Сложно", 48),
    ("mountain-sunset", "Mountain Sunset", "Nature", "Средне", 38),
    ("forest-clearing", "Forest Clearing", "Nature", "Легко", 26),
    ("kimono", "Kimono Rack", "Culture", "Сложно", 50),
    ("winter-forest", "Winter Forest", "Nature", "Средне", 34),
    ("mountain-stream", "Mountain Stream", "Nature", "Средне", 40),
    ("night-city-2", "Night City", "Architecture", "Средне", 45),
    ("space-rocks", "Space Rocks", "Cosmos", "Средне", 44),
    ("garden-birds", "Garden Birds", "Nature", "Легко", 30),
    ("soccer-ball", "Soccer Ball", "Sports", "Легко", 22),
    ("lake-pines", "Pine Lake Forest", "Nature", "Средне", 40),
    ("urban-bridge", "Urban Bridge", "Architecture", "Средне", 42),
    ("cat-window", "Cat in the Window", "Animals", "Легко", 26),
    ("mountain-peaks", "Mountain Peaks", "Nature", "Сложно", 52),
)


def artworks(spark: SparkSession) -> DataFrame:
    """(place, id, title, category, difficulty, minutes) of the pictures of the catalog."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(ROWS)], "place int, id string, title string, category string, difficulty string, minutes int")


def read_artworks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalog of one's own: a folder of JSON files, one picture each, with palettes and drawings as ``schema`` names them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
