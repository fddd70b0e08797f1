"""Python's operators and NumPy's protocols for handles.

All of them build expressions, but for what needs numbers: np.asarray and NumPy functions other than element-wise ones bring the
values, in order of key and period, to the driver.
"""

from __future__ import annotations

import numbers
from collections.abc import Callable
from typing import Any

import numpy as np

_SIGNS = {np.add: "+", np.subtract: "-", np.multiply: "*", np.true_divide: "/", np.floor_divide: "//", np.remainder: "%", np.power: "**"}
_TESTS = {np.equal: "==", np.not_equal: "!=", np.less: "<", np.less_equal: "<=", np.greater: ">", np.greater_equal: ">="}
_LOGIC = {np.logical_and: "and", np.logical_or: "or", np.logical_xor: "xor", np.bitwise_and: "and", np.bitwise_or: "or", np.bitwise_xor: "xor"}


def _operand(x: object) -> bool:
    return isinstance(x, (Algebra, numbers.Real, np.number, np.bool_)) or (isinstance(x, np.ndarray) and x.ndim == 0)


def _plain(x: Any) -> Any:
    return x if isinstance(x, Algebra) else float(x)


def _binary(call: str, sign: str, reflected: bool = False) -> Callable[[Any, Any], Any]:
    def run(self: Any, other: Any) -> Any:
        from seriesloom.operators import align

        if not _operand(other):
            return NotImplemented
        a, b = (_plain(other), self) if reflected else (self, _plain(other))
        return getattr(align, call)(a, sign, b)

    return run


class Algebra:
    """What SeriesFrame inherits. Comparisons are element by element, so handles hash by identity."""

    __array_priority__ = 1000

    __add__, __radd__ = _binary("arithmetic", "+"), _binary("arithmetic", "+", True)
    __sub__, __rsub__ = _binary("arithmetic", "-"), _binary("arithmetic", "-", True)
    __mul__, __rmul__ = _binary("arithmetic", "*"), _binary("arithmetic", "*", True)
    __truediv__, __rtruediv__ = _binary("arithmetic", "/"), _binary("arithmetic", "/", True)
    __floordiv__, __rfloordiv__ = _binary("arithmetic", "//"), _binary("arithmetic", "//", True)
    __mod__, __rmod__ = _binary("arithmetic", "%"), _binary("arithmetic", "%", True)
    __pow__, __rpow__ = _binary("arithmetic", "**"), _binary("arithmetic", "**", True)
    # in place: rows without a partner stay as they are
    __iadd__, __isub__, __imul__, __itruediv__, __ipow__ = (_binary("update", sign) for sign in ("+", "-", "*", "/", "**"))
    __eq__, __ne__ = _binary("compare_elements", "=="), _binary("compare_elements", "!=")  # type: ignore[assignment]
    __lt__, __le__ = _binary("compare_elements", "<"), _binary("compare_elements", "<=")
    __gt__, __ge__ = _binary("compare_elements", ">"), _binary("compare_elements", ">=")
    __and__, __rand__ = _binary("logical", "and"), _binary("logical", "and", True)
    __or__, __ror__ = _binary("logical", "or"), _binary("logical", "or", True)
    __xor__, __rxor__ = _binary("logical", "xor"), _binary("logical", "xor", True)
    __hash__ = object.__hash__

    def _function(self, name: str) -> Any:
        from seriesloom.operators import align

        return align.function(name, self)

    def __neg__(self) -> Any:
        return self._function("negative")

    def __pos__(self) -> Any:
        return self._function("positive")

    def __abs__(self) -> Any:
        return self._function("absolute")

    def __invert__(self) -> Any:
        from seriesloom.operators import align

        return align.logical(self, "xor", 1.0)

    def __matmul__(self, other: Any) -> Any:
        """With a series: the inner product by position (a number, or a row per key). With a matrix: rows times it, variables named from 1."""
        from seriesloom.operators import align

        if isinstance(other, Algebra):
            made = align.inner(self, other)
            return made if self.keys else made.first()["value"]
        weights = np.asarray(other, dtype=float)
        if weights.ndim not in (1, 2) or weights.shape[0] != len(self.cols):
            raise ValueError(f"a matrix of {len(self.cols)} rows is needed, found the shape {weights.shape}")
        columns = weights.reshape(len(self.cols), -1).T.tolist()
        return align.matmul(self, {"value" if weights.ndim == 1 else str(k): dict(zip(self.cols, c, strict=True)) for k, c in enumerate(columns, 1)})

    def __rmatmul__(self, other: Any) -> Any:
        """A vector or matrix times a series: a number, or as many (a DataFrame of row and value, per key)."""
        from seriesloom.operators import align

        weights = np.asarray(other, dtype=float)
        rows = [(i, j, v) for i, own in enumerate(np.atleast_2d(weights).tolist()) for j, v in enumerate(own)]
        made = align.left_matmul(self.spark.createDataFrame(rows, "row long, position long, weight double"), self)
        return made.first()["value"] if weights.ndim == 1 and not self.keys else made

    # --- NumPy ---

    def __array__(self, dtype: Any = None, copy: bool | None = None) -> np.ndarray:
        if copy is False:
            raise ValueError("the values have to be fetched, so they are always a copy")
        table = self.df.orderBy(*self.index).select(*self.cols).toArrow()
        made = np.stack([table.column(i).to_numpy() for i in range(len(self.cols))], axis=1)
        made = made[:, 0] if len(self.cols) == 1 else made
        return made if dtype is None else made.astype(dtype)

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs: Any, out: Any = None, **options: Any) -> Any:
        from seriesloom.operators import align

        if out is not None:
            return NotImplemented
        if method != "__call__":
            return getattr(ufunc, method)(*map(_fetched, inputs), **options)
        if ufunc is np.matmul:
            return inputs[0] @ inputs[1] if isinstance(inputs[0], Algebra) else inputs[1].__rmatmul__(inputs[0])
        if len(inputs) == 1:
            return align.apply(self, ufunc)
        if len(inputs) != 2 or not all(map(_operand, inputs)):
            return NotImplemented
        a, b = map(_plain, inputs)
        for table, call in ((_SIGNS, align.arithmetic), (_TESTS, align.compare_elements), (_LOGIC, align.logical)):
            if ufunc in table:
                return call(a, table[ufunc], b)
        if ufunc in (np.maximum, np.minimum):
            return (align.maximum if ufunc is np.maximum else align.minimum)(a, b)
        return NotImplemented

    def __array_function__(self, func: Callable, types: Any, args: tuple, options: dict) -> Any:
        """np.concatenate puts handles below each other (axis 0) or side by side (axis 1); other functions get the values."""
        from seriesloom.operators import align

        if func is np.concatenate and all(isinstance(x, Algebra) for x in args[0]):
            axis = options.get("axis", args[1] if len(args) > 1 else 0)
            return align.vcat(*args[0]) if axis == 0 else align.hcat(*args[0])
        return func(*map(_fetched, args), **{k: _fetched(v) for k, v in options.items()})

    # --- conversion ---

    def to_pandas(self, **how: Any) -> Any:
        from seriesloom.sources import frames

        return frames.to_pandas(self, **how)

    def to_polars(self, **how: Any) -> Any:
        from seriesloom.sources import frames

        return frames.to_polars(self, **how)


def _fetched(x: Any) -> Any:
    if isinstance(x, Algebra):
        return np.asarray(x)
    return type(x)(map(_fetched, x)) if isinstance(x, (list, tuple)) else x
