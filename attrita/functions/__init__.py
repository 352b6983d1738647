from attrita.functions.bins import right_closed_bin, equal_width_bin
from attrita.functions.stats import safe_corr, rnd
from attrita.functions import rules

__all__ = ["right_closed_bin", "equal_width_bin", "safe_corr", "rnd", "rules"]
