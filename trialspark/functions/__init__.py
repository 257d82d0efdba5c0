"""Column expressions used by the operators (all JVM-side, codegen friendly)."""

from trialspark.functions.keys import (ENV_RECODE, build_key, nan_to_null, recode,
                                       round_half_even, split_key, strip_pattern)

__all__ = ["ENV_RECODE", "build_key", "nan_to_null", "recode", "round_half_even",
           "split_key", "strip_pattern"]
