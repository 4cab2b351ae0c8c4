from weirflow.functions.foldings import Folding, any_, count_, max_, min_, sum_
from weirflow.functions.paths import PathPattern
from weirflow.functions.values import add, bigger, copied, guarded, inc, smaller, zero

__all__ = ["Folding", "PathPattern", "add", "any_", "bigger", "copied", "count_", "guarded", "inc", "max_", "min_", "smaller", "sum_", "zero"]
