"""Small vocabularies of the building domain, as plain fixed values."""

# Material classes.
MATERIALS = [
    "Thatch", "StoneSlates", "ClayTiles", "AsphaltTiles", "ConcreteTiles", "WoodTiles", "MetalSheetMaterials", "PolycarbonateSheetMaterials",
    "GlassSheetMaterials", "AmorphousConcrete", "AmorphousAsphalt", "AmorphousMembrane", "AmorphousFabric", "Unknown", "GreenVegetative",
]
# Damage classes from least to most severe.
DAMAGE_CLASSES = ["no-damage", "minor-damage", "major-damage", "destroyed"]
# Rank of a class, the most severe first; tables also write two of them short.
SEVERITY = {"destroyed": 0, "major-damage": 1, "major": 1, "minor-damage": 2, "minor": 2, "no-damage": 3}
# Class of each of the five damage probabilities, in their order.
PROBABILITY_CLASSES = ["no-damage", "minor-damage", "minor-damage", "major-damage", "destroyed"]
# Class of a surveyed damage level, lower case.
LEVEL_CLASSES = {"slight": "minor-damage", "moderate": "minor-damage", "damaged": "major-damage", "extensive": "major-damage", "complete": "destroyed"}
# Codes of roof classes; others have none.
ROOF_CODES = {
    "AmorphousConcrete": 10, "ClayTiles": 10, "MetalSheetMaterials": 34, "AmorphousAsphalt": 23, "AmorphousMembrane": 99, "AmorphousFabric": 99,
    "GreenVegetative": 45, "Unknown": 99,
}
# Roof codes of flexible diaphragms and of unreinforced masonry; wall code where none is known.
FLEXIBLE_CODES = [34, 45, 72]
MASONRY_CODES = [21, 34, 40, 41, 45, 71, 72]
NO_WALL = 501
# Land-use codes that are residential, and height limits in metres by code.
RESIDENTIAL_USES = [1, 2, 3, 4, 11, 12, 13, 14, 15]
HEIGHT_LIMITS = {11: (0, 3), 21: (0, 3), 12: (3, 6), 22: (3, 6), 13: (6, 15), 23: (6, 15), 14: (15, 30), 24: (15, 30), 15: (30, 500), 25: (30, 500)}
# Assignment modes; the first is the material-aware one.
MODES = ["material", "benchmark", "unreinforced", "reinforced"]
SPLITS = ["train", "val", "holdout"]
JOB_STATES = ["pending", "running", "done", "failed"]
