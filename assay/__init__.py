"""assay: dataset validation and profiling on Spark.

The names below are what a caller needs; the parts are in the subpackages.
"""

from assay.plans.results import document, manifest, verify
from assay.plans.rules import RulesError, effective, load
from assay.plans.run import Result, Run, check, load_plugins, validate
from assay.sources.dataset import Dataset

__all__ = ["Dataset", "Result", "RulesError", "Run", "check", "document", "effective", "load", "load_plugins", "manifest", "validate", "verify"]
