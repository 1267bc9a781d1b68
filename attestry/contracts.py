"""Fixed vocabularies and column contracts."""

from __future__ import annotations

# Taxonomy of labels.
SUBCLASSES = ["1A", "1B", "1C", "1D", "1E", "1F", "1G", "0A", "0B", "0C"]
RADS = ["RAD-H", "RAD-M", "RAD-L", "RAD-NA"]
ERAS = ["PRE-GENAI", "GENAI-ERA"]

# Inclusive ranges, tested in order.
FUNDING_BUCKETS = [("unknown", None, 0), ("<$1M", 1, 1_000_000), ("$1-10M", 1_000_001, 10_000_000), ("$10-100M", 10_000_001, 100_000_000), ("$100M+", 100_000_001, None)]
AGE_BUCKETS = [("0-30", 0, 30), ("31-90", 31, 90), ("91-365", 91, 365), ("366+", 366, None)]
DRIFT_BUCKETS = [("<=7", None, 7), ("8-30", 8, 30), ("31-90", 31, 90), ("91-180", 91, 180), ("181+", 181, None)]
CAPTURE_BUCKETS = [("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), ("101+", 101, None)]
HISTOGRAM_EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0000001]

# Column order of the company table and of the classifier's input.
MASTER_COLUMNS = ["org_uuid", "name", "short_description", "Long description", "category_list", "category_groups_list", "founded_date", "employee_count", "total_funding_usd", "homepage_url", "website_alive"]
CLASSIFIER_COLUMNS = [*MASTER_COLUMNS, "website_pages_used", "website_evidence"]

# Dollars for a million input, cached and output tokens.
PRICES = {"small": (0.20, 0.10, 1.25), "medium": (0.75, 0.375, 4.50), "large": (1.00, 0.50, 6.00)}

# Rows wanted of each subclass in a golden set.
QUOTAS = {"1A": 8, "1B": 8, "1C": 8, "1D": 8, "1E": 8, "1F": 8, "1G": 8, "0A": 24, "0B": 8, "0C": 12}
