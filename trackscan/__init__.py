"""Web-tracking analytics on Spark DataFrames and streams."""

from trackscan.params import ScoringParams
from trackscan.plans.basic_scan import scan
from trackscan.plans.enhanced_scan import enhanced_scan

__all__ = ["ScoringParams", "enhanced_scan", "scan"]
