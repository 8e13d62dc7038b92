"""Cross approximation of a matrix that grows pivot by pivot, from its own rows and columns.

The matrix is a tensor with row and column indices; a pivot costs a filter for its row and one for its column, and a join
each to take off what is known already. Nothing but pivots and coordinates of lists reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..index import Index, new_link
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair, stack, zeros
from .factorize import _sides

At = Mapping[Index, int]


def _listed(indices: Sequence[Index], some: Sequence[At]) -> Column:
    """Is the coordinate one of those listed?"""
    out = F.lit(False)
    for at in some:
        one = F.lit(True)
        for i in indices:
            one = one & (F.col(i.column) == at[i])
        out = out | one
    return out


@dataclass
class GrowingCross:
    """matrix is about the sum over pivots of column k times row k; rows are divided by their pivot."""

    matrix: Tensor
    left: list[Index]
    right: list[Index]
    pivots: list[tuple[dict[Index, int], dict[Index, int]]] = field(default_factory=list)
    columns: list[Tensor] = field(default_factory=list)
    rows: list[Tensor] = field(default_factory=list)

    @staticmethod
    def of(matrix: Tensor, left: Sequence[Index], first: tuple[At, At] | None = None) -> GrowingCross:
        """With a first pivot: the given one, or the largest entry."""
        rows, cols = _sides(matrix, left)
        out = GrowingCross(matrix, rows, cols)
        at = matrix.argmax() if first is None else None
        out.add_pivot(*(first or ({i: at[i] for i in rows}, {i: at[i] for i in cols})))
        return out

    @property
    def rank(self) -> int:
        return len(self.pivots)

    def factors(self) -> tuple[Tensor, Tensor]:
        """Columns (left, bond) and rows (bond, right)."""
        bond = new_link(max(1, self.rank))
        if not self.rank:
            return zeros(self.matrix.spark, [*self.left, bond]), zeros(self.matrix.spark, [bond, *self.right])
        return stack(self.columns, bond), stack(self.rows, bond)

    def to_matrix(self) -> Tensor:
        return contract_pair(*self.factors())

    def residual(self) -> Tensor:
        return self.matrix.sub(self.to_matrix()) if self.rank else self.matrix

    def row(self, at: At) -> Tensor:
        """The approximation's row."""
        u, v = self.factors()
        return contract_pair(u.select_indices(at), v)

    def column(self, at: At) -> Tensor:
        u, v = self.factors()
        return contract_pair(u, v.select_indices(at))

    def submatrix(self, rows: Sequence[At], cols: Sequence[At]) -> Tensor:
        u, v = self.factors()
        return contract_pair(u._like(u.df.where(_listed(self.left, rows))), v._like(v.df.where(_listed(self.right, cols))))

    def evaluate(self, row: At, col: At) -> complex:
        return self.row(row).select_indices(col).only()

    def local_error(self, rows: Sequence[At], cols: Sequence[At]) -> Tensor:
        """Absolute residuals at listed rows and columns."""
        m = self.matrix
        some = m._like(m.df.where(_listed(self.left, rows) & _listed(self.right, cols))).sub(self.submatrix(rows, cols))
        return some.map_values(lambda *v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0])))

    def available(self, side: str) -> list[dict[Index, int]]:
        """Coordinates of one index that no pivot uses yet; for sides of a single index."""
        (i,) = self.left if side == "rows" else self.right
        used = {p[0 if side == "rows" else 1][i] for p in self.pivots}
        return [{i: k} for k in range(i.dim) if k not in used]

    def find_new_pivot(self, rows: Sequence[At] | None = None, cols: Sequence[At] | None = None) -> tuple[tuple[dict, dict], float]:
        """Where the residual is largest, among listed rows and columns if given, and how large."""
        rest = self.residual()
        if rows is not None:
            rest = rest._like(rest.df.where(_listed(self.left, rows)))
        if cols is not None:
            rest = rest._like(rest.df.where(_listed(self.right, cols)))
        top = rest.df.withColumn("weft_abs", rest.abs2()).orderBy(F.desc("weft_abs"), *reversed(rest.columns)).first()
        at = lambda own: {i: int(top[i.column]) if top else 0 for i in own}
        return (at(self.left), at(self.right)), (float(top.weft_abs) ** 0.5 if top else 0.0)

    def add_pivot(self, row: At, col: At) -> float:
        """Takes the cross at (row, col) in; the residual's absolute value there, which must not be 0."""
        column = self.matrix.select_indices(col)
        line = self.matrix.select_indices(row)
        if self.rank:
            column, line = column.sub(self.column(col)), line.sub(self.row(row))
        column = column._like(cut_lineage(column.df))
        pivot = column.select_indices(row).only()
        if pivot == 0:
            raise ValueError("the residual is 0 there")
        line = line.scale(1 / pivot)
        self.columns.append(column)
        self.rows.append(line._like(cut_lineage(line.df)))
        self.pivots.append((dict(row), dict(col)))
        return abs(pivot)

    def add_best_pivot(self) -> float:
        """The largest residual becomes a pivot, unless it is 0."""
        at, size = self.find_new_pivot()
        return self.add_pivot(*at) if size else 0.0

    def add_pivot_row(self, row: At) -> float:
        """The largest residual of a row becomes a pivot."""
        line = self.matrix.select_indices(row)
        return self._along(line.sub(self.row(row)) if self.rank else line, lambda at: (row, at))

    def add_pivot_column(self, col: At) -> float:
        line = self.matrix.select_indices(col)
        return self._along(line.sub(self.column(col)) if self.rank else line, lambda at: (at, col))

    def _along(self, line: Tensor, place) -> float:
        return self.add_pivot(*place(line.argmax())) if line.maxabs() else 0.0
