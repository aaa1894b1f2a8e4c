from vigil.functions.typegate import NUMERIC_STRING_PATTERN, numeric_value, is_numeric_eligible
from vigil.functions.columns import compact, fingerprint

__all__ = ["NUMERIC_STRING_PATTERN", "numeric_value", "is_numeric_eligible",
           "compact", "fingerprint"]
