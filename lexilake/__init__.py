"""lexilake: localization string catalogs as Spark tables and jobs."""

__version__ = "0.1.0"
