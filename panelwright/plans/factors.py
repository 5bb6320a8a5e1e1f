"""Factor definitions as composable builders.

A :class:`Term` names a computation over panel fields.  Building one does no work;
:func:`add_terms` turns terms into window expressions on a densified panel.  Equal
sub-terms are computed once, and everything that only looks along time is placed
before the first cross-sectional step, so a whole library needs one shuffle by
entity and one by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions import scalar, timeseries as ts
from panelwright.functions.text import FIELDS
from panelwright.operators.crosssection import CrossSection
from panelwright.sources.panel import KEY, Panel, densify

# Limits on one definition.
MAX_DEPTH = 8
MAX_NODES = 80


@dataclass(frozen=True)
class Term:
    """One value per (entity, date)."""

    text: str
    kind: str  # field | number | row | time | cross
    inputs: tuple["Term", ...] = ()
    step: Callable | None = dc_field(default=None, compare=False, repr=False)
    own_nodes: int = 1
    own_windows: frozenset = frozenset()
    is_call: bool = False
    #: NULL exactly where its input is.
    keeps_nulls: bool = False

    @property
    def nodes(self) -> int:
        return self.own_nodes + sum(t.nodes for t in self.inputs)

    @property
    def depth(self) -> int:
        return int(self.is_call) + max((t.depth for t in self.inputs), default=0)

    @property
    def windows(self) -> list[int]:
        return sorted(self.own_windows.union(*[t.windows for t in self.inputs]))

    @property
    def fields(self) -> list[str]:
        own = {self.text} if self.kind == "field" else set()
        own |= {"industry"} if self.text.startswith("neutralize_industry(") else set()
        own |= {"market_cap"} if self.text.startswith("neutralize_size(") else set()
        return sorted(own.union(*[t.fields for t in self.inputs]))

    @property
    def crosses(self) -> bool:
        return self.kind == "cross" or any(t.crosses for t in self.inputs)

    @property
    def complexity(self) -> int:
        return 1 + self.nodes + 2 * len(self.windows)

    def check(self) -> "Term":
        if 1 + self.depth > MAX_DEPTH:
            raise ValueError(f"{self.text}: depth {1 + self.depth} exceeds {MAX_DEPTH}")
        if 1 + self.nodes > MAX_NODES:
            raise ValueError(f"{self.text}: {1 + self.nodes} nodes exceed {MAX_NODES}")
        return self

    def __add__(self, other): return _arith("+", self, other, lambda a, b: a + b)
    def __radd__(self, other): return _arith("+", other, self, lambda a, b: a + b)
    def __sub__(self, other): return _arith("-", self, other, lambda a, b: a - b)
    def __rsub__(self, other): return _arith("-", other, self, lambda a, b: a - b)
    def __mul__(self, other): return _arith("*", self, other, lambda a, b: a * b)
    def __rmul__(self, other): return _arith("*", other, self, lambda a, b: a * b)
    def __truediv__(self, other): return _arith("/", self, other, scalar.divide)
    def __rtruediv__(self, other): return _arith("/", other, self, scalar.divide)

    def __neg__(self):
        return Term(f"-{_wrap(self)}", "row", (self,), lambda a: -a)

    def __pos__(self):
        return Term(f"+{_wrap(self)}", "row", (self,), lambda a: a)


def _wrap(t: Term) -> str:
    return f"({t.text})" if t.kind == "row" and not t.is_call else t.text


def _term(value) -> Term:
    if isinstance(value, Term):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"not a number or term: {value!r}")
    return Term(str(value), "number", (), lambda: scalar.lit_double(value))


def _arith(sign: str, left, right, build) -> Term:
    left, right = _term(left), _term(right)
    return Term(f"{_wrap(left)} {sign} {_wrap(right)}", "row", (left, right), build)


def _window_call(name: str, inputs: Sequence, n: int, build, smallest: int = 1) -> Term:
    inputs = tuple(_term(x) for x in inputs)
    ts.check_window(n, smallest)
    text = f"{name}({', '.join(t.text for t in inputs)}, {n})"
    return Term(text, "time", inputs, build, own_nodes=2, own_windows=frozenset([n]), is_call=True).check()


def _cross_call(name: str, x, build, args: str = "", extra_nodes: int = 0, keeps_nulls: bool = False) -> Term:
    x = _term(x)
    return Term(f"{name}({x.text}{args})", "cross", (x,), build, own_nodes=1 + extra_nodes, is_call=True, keeps_nulls=keeps_nulls).check()


def fld(name: str) -> Term:
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}")
    return Term(name, "field")


def delay(x, n): return _window_call("delay", [x], n, lambda w, a: ts.delay(a, n, w))
def delta(x, n): return _window_call("delta", [x], n, lambda w, a: ts.delta(a, n, w))
def ts_return(x, n): return _window_call("ts_return", [x], n, lambda w, a: ts.ts_return(a, n, w))
def ts_mean(x, n): return _window_call("ts_mean", [x], n, lambda w, a: ts.ts_mean(a, n, w), 2)
def ts_std(x, n): return _window_call("ts_std", [x], n, lambda w, a: ts.ts_std(a, n, w), 2)
def ts_rank(x, n): return _window_call("ts_rank", [x], n, lambda w, a: ts.ts_rank(a, n, w), 2)
def ts_zscore(x, n): return _window_call("ts_zscore", [x], n, lambda w, a: ts.ts_zscore(a, n, w), 2)
def ts_corr(x, y, n): return _window_call("ts_corr", [x, y], n, lambda w, a, b: ts.ts_corr(a, b, n, w), 2)


ret = ts_return


def rank(x): return _cross_call("rank", x, lambda cs, df, a, out: cs.rank(df, a, out), keeps_nulls=True)
def zscore(x): return _cross_call("zscore", x, lambda cs, df, a, out: cs.zscore(df, a, out))


def winsorize(x, lower: float = 0.01, upper: float = 0.99):
    return _cross_call(
        "winsorize", x, lambda cs, df, a, out: cs.winsorize(df, a, out, lower, upper),
        args=f", lower={lower}, upper={upper}", extra_nodes=2, keeps_nulls=True,
    )


def neutralize_industry(x):
    return _cross_call("neutralize_industry", x, lambda cs, df, a, out: cs.neutralize_industry(df, a, out))


def neutralize_size(x):
    return _cross_call("neutralize_size", x, lambda cs, df, a, out: cs.neutralize_size(df, a, out))


def signed_power(x, p: float):
    x = _term(x)
    return Term(f"signed_power({x.text}, {p})", "row", (x,), lambda a: scalar.signed_power(a, p), own_nodes=2, is_call=True)


def log1p_abs(x):
    x = _term(x)
    return Term(f"log1p_abs({x.text})", "row", (x,), scalar.log1p_abs, is_call=True)


# --------------------------------------------------------------------------
# Terms to columns


class _Stage:
    """A grid frame being widened term by term."""

    def __init__(self, grid: DataFrame, cross: CrossSection):
        self.df = grid
        self.cross = cross
        self.window = ts.entity_window()
        self.done: dict[str, str] = {}

    def column(self, term: Term) -> Column:
        if term.kind == "field":
            return F.col(term.text)
        if term.kind == "number":
            return term.step()
        if term.kind == "row":
            return term.step(*[self.column(t) for t in term.inputs])
        return F.col(self.materialise(term))

    def materialise(self, term: Term) -> str:
        """Give the term a column and return its name."""
        if term.kind == "field":
            return term.text
        if term.text in self.done:
            return self.done[term.text]
        name = f"_t{len(self.done)}"
        if term.kind == "time":
            args = [F.col(self.materialise(t)) for t in term.inputs]
            name = f"_t{len(self.done)}"
            self.df = self.df.withColumn(name, term.step(self.window, *args))
        elif term.kind == "cross":
            arg = self.materialise(term.inputs[0])
            name = f"_t{len(self.done)}"
            self.df = term.step(self.cross, self.df, arg, name)
        else:
            value = self.column(term)
            name = f"_t{len(self.done)}"
            self.df = self.df.withColumn(name, value)
        self.done[term.text] = name
        return name

    def prepare_time(self, term: Term) -> None:
        """Compute every purely temporal sub-term before any cross-section."""
        if not term.crosses:
            if term.kind not in ("field", "number"):
                self.materialise(term)
            return
        for t in term.inputs:
            self.prepare_time(t)


def known_by(term: Term) -> Term | None:
    """The purely temporal term that is NULL exactly where this one is, if there is one."""
    if not term.crosses:
        return term
    return known_by(term.inputs[0]) if term.kind == "cross" and term.keeps_nulls else None


def add_terms(grid: DataFrame, cross: CrossSection, terms: dict[str, Term], follow: Sequence["Follow"] = ()) -> DataFrame:
    """Add one column per named term to a densified panel.

    What ``follow`` takes from an entity's later rows is added along with the steps
    along time, for the terms that are known to be NULL or not by then.
    """
    stage = _Stage(grid, cross)
    for term in terms.values():
        stage.prepare_time(term)
    early = {}
    for name, term in terms.items() if follow else ():
        known = known_by(term)
        if known is not None and known.kind != "number":
            early[name] = F.col("present") & F.col(stage.materialise(known)).isNotNull()
    stage.df = follow_up(stage.df, early, follow)
    columns = {name: stage.materialise(term) for name, term in terms.items()}
    return stage.df.select(
        *grid.columns, *[f"{f.prefix}{n}" for f in follow for n in early], *[F.col(source).cast("double").alias(name) for name, source in columns.items()]
    )


def factor_wide(panel: Panel, terms: dict[str, Term], carry: Iterable[str] = (), follow: Sequence["Follow"] = ()) -> DataFrame:
    """Real panel rows with one column per factor plus the carried fields, and what ``follow`` takes for each factor."""
    needed = sorted({f for t in terms.values() for f in t.fields} | set(carry))
    needed = [c for c in needed if c in panel.df.columns]
    grid = densify(panel.select(*KEY, *needed))
    wide = add_terms(grid, panel.cross_section(), terms, follow).filter("present")
    found = [c for f in follow for c in (f"{f.prefix}{n}" for n in terms) if c in wide.columns]
    wide = wide.select(*KEY, *[c for c in carry if c in needed], *terms, *found)
    # the others are only known after the cross-sections, which costs one more sort by entity
    late = {n: F.col(f"`{n}`").isNotNull() for n in terms if follow and f"{follow[0].prefix}{n}" not in found}
    return follow_up(wide, late, follow)


def to_long(wide: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (factor, entity, date) with a value; missing values drop out."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.select(*keep, F.expr(f"stack({len(names)}, {pairs}) as (factor_name, value)")).filter(
        F.col("value").isNotNull()
    )


#: What of an entity's next row a factor's row may carry.
AHEAD = ("close", "limit_up_flag", "limit_down_flag")


@dataclass(frozen=True)
class Follow:
    """What a factor's row carries of the entity's later rows that have a value of the factor.

    ``row`` says what of a row, and is NULL where the row does not count; ``steps`` which
    of the rows that count, one or several.  Taken on the wide rows, one sort by entity
    serves all factors; on the long table it would sort every factor's rows.
    """

    prefix: str
    row: Callable[[DataFrame, Column], Column]
    steps: int | tuple[int, ...]

    def lead(self, column: str) -> Column:
        over = "OVER (PARTITION BY entity ORDER BY date)"
        one = lambda n: F.expr(f"lead(`{column}`, {n}) IGNORE NULLS {over}")
        return one(self.steps) if isinstance(self.steps, int) else F.array(*[one(n) for n in self.steps])


def follow_up(df: DataFrame, there: dict[str, Column], follow: Sequence[Follow]) -> DataFrame:
    """Add ``<prefix><name>`` for the factors of ``there``, which says on which rows a factor has a value."""
    if not there:
        return df
    rows = {f"_row{f.prefix}{n}": f.row(df, c) for f in follow for n, c in there.items()}
    return df.withColumns(rows).withColumns({f"{f.prefix}{n}": f.lead(f"_row{f.prefix}{n}") for f in follow for n in there}).drop(*rows)


#: Price and flags of the next row.
NEXT_ROW = Follow("_ahead_", lambda df, there: F.when(there, F.struct(*[c for c in AHEAD if c in df.columns])), 1)


def later_rows(horizons: Sequence[int]) -> Follow:
    """Prices so many tradable rows later, in the order of ``horizons``; they mean something on tradable rows only."""

    def row(df: DataFrame, there: Column) -> Column:
        for flag in ("ST", "suspended", "limit_up_flag", "limit_down_flag"):
            if flag in df.columns:
                there = there & ~scalar.is_true(flag)
        return F.when(there, F.struct("close"))

    return Follow("_later_", row, tuple(horizons))


def factor_long(
    panel: Panel, terms: dict[str, Term], carry: Sequence[str] = (), batch: int = 40, ahead: bool = False, horizons: Sequence[int] = ()
) -> DataFrame:
    """Long factor table of a library, in batches so that plans stay small.

    With ``ahead`` each row carries a struct of price and flags of the factor's next
    row, with ``horizons`` the array ``later`` of :func:`later_rows`, and evaluation
    needs no further window over entities.
    """
    names = list(terms)
    follow = [*([NEXT_ROW] if ahead else []), *([later_rows(horizons)] if horizons else [])]
    extra = [f.prefix.strip("_") for f in follow]
    out = None
    for i in range(0, len(names), batch):
        part = names[i : i + batch]
        wide = factor_wide(panel, {n: terms[n] for n in part}, carry, follow)
        cells = ", ".join(", ".join([f"'{n}'", f"`{n}`", *[f"`{f.prefix}{n}`" for f in follow]]) for n in part)
        stacked = wide.select(*KEY, *carry, F.expr(f"stack({len(part)}, {cells}) as ({', '.join(['factor_name', 'value', *extra])})"))
        long = stacked.filter(F.col("value").isNotNull()).select("factor_name", *KEY, "value", *carry, *extra)
        out = long if out is None else out.unionByName(long)
    return out
