"""Choice of bins for a range of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count


@dataclass(frozen=True)
class Bins:
    """Bins of one width from ``start`` to ``stop``."""

    start: float
    stop: float
    step: float

    def through(self, anchor: float) -> Bins:
        """The bins moved up, by less than a step, so that one of them starts at ``anchor`` (or would, carried on)."""
        up = (anchor - self.start) % self.step
        return replace(self, start=self.start + up, stop=self.stop + up)

    def __len__(self) -> int:
        return max(1, math.ceil((self.stop - self.start) / self.step))


def _exponent(x: float, base: float) -> float:
    return math.log(x) / math.log(base)


def _width(span: float, maxbins: float, base: float, minstep: float, divide) -> float:
    """The width of bins, a power of ``base`` if ``divide`` allows no finer one, of which ``maxbins`` cover ``span``."""
    fits = lambda width: span / width <= maxbins
    finest = max(minstep, base ** (math.floor(_exponent(span, base) + 0.5) - math.ceil(_exponent(maxbins, base))))
    coarse = next(w for w in (finest * base**i for i in count()) if math.ceil(span / w) <= maxbins)
    return reduce(lambda width, part: width / part if width / part >= minstep and fits(width / part) else width, divide, coarse)


def solve(low, high, maxbins=20, base=10, step=None, steps=None, span=None, minstep=0, divide=(5, 2), nice=True) -> Bins:
    """At most ``maxbins`` bins from ``low`` to ``high``.

    Their width is ``step`` if given, else the first of ``steps`` that is wide enough (the last
    if none is), else chosen. ``nice`` bounds are whole multiples of the width.
    """
    low, high = float(low or 0), float(high or 0)
    if low > high:
        raise ValueError(f"the extent of bins ends at {high}, before it starts at {low}")
    span = span or (high - low) or abs(low) or 1.0
    if step is None:
        wide = [s for s in steps or [] if s * maxbins > span]
        step = wide[0] if wide else steps[-1] if steps else _width(span, maxbins, base, minstep, divide)
    step = float(step)
    if nice is not False:
        # a bound that is a multiple but for rounding counts as one: half a place behind the width's own decimals does not matter
        decimals = 0 if step >= 1 else int(-_exponent(step, base)) + 1
        below = math.floor(low / step + float(base) ** -(decimals + 1)) * step
        low, high = (below if below <= low else below - step), math.ceil(high / step) * step
    return Bins(low, high if high != low else low + step, step)
