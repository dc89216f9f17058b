"""The users' formula language as column expressions: nothing of a formula runs in Python.

``+ - * / % ^``, comparisons, ``and or not`` (``&& || !``), ``if(cond, then, else)``, ``'text'``, bare names and
``[names with signs]``. A value that is missing or not a number makes arithmetic
missing, never zero; so does a division by zero or any other result that isn't finite. Comparing a missing value is
unknown, and so is ``if`` of it. Two values compare as numbers where both are, else as trimmed text
without case. ``and`` and ``or`` follow three-valued logic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.assay import OXIDE_FACTOR, UNIT_PPM

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<text>'[^']*'|\"[^\"]*\")|\[(?P<quoted>[^\]]*)\]|(?P<name>[A-Za-z_]\w*)|(?P<sign><=|>=|==|!=|<>|&&|\|\||[-+*/%^(),<>=!]))", re.ASCII)
_NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SAME = {"&&": "and", "||": "or", "==": "=", "<>": "!=", "!": "not"}
#: How tightly what stands between two values binds; ``^`` binds to the right.
_BINDS = {"or": 1, "and": 2, "<": 4, "<=": 4, ">": 4, ">=": 4, "=": 4, "!=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "^": 8}
_NOT, _SIGNED = 3, 7
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


class FormulaError(ValueError):
    """What is wrong with a formula, and at which of its letters (from 1)."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} (at {position})")
        self.position = position


@dataclass
class Value:
    """An expression and what it is: number, text or flag. ``finite``: it can't be NaN or infinite."""

    kind: str
    column: Column
    finite: bool = False

    def number(self) -> Column:
        if self.kind == "number":
            return self.column if self.finite else F.when(~F.isnan(self.column) & (F.abs(self.column) < float("inf")), self.column)
        if self.kind == "flag":
            return F.lit(None).cast("double")
        bare = F.trim(self.column)
        return Value("number", F.when(bare.rlike(_NUMERAL), bare).try_cast("double")).number()

    def text(self) -> Column:
        """As it would be typed: whole numbers without a point."""
        return self.column if self.kind == "text" else F.regexp_replace(self.column.cast("string"), r"\.0$", "")

    def truth(self) -> Column:
        if self.kind == "flag":
            return self.column
        if self.kind == "number":
            return self.number() != 0
        return F.when(self.column != "", F.coalesce(self.number() != 0, F.lit(True)))


def _whole(pick: Callable) -> Callable:
    """Whole numbers beyond the long integers are whole already."""
    return lambda x: F.when(F.abs(x) < 1e15, pick(x).cast("double")).otherwise(x)


def _lesser(pick: Callable) -> Callable:
    def of(*args: Column) -> Column:
        if len(args) == 1:
            return args[0]
        known = args[0].isNotNull()
        for a in args[1:]:
            known = known & a.isNotNull()
        return F.when(known, pick(*args))

    return of


#: Name -> least and most arguments, and the expression.
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "sqrt": (1, 1, F.sqrt),
    "min": (1, None, _lesser(F.least)),
    "max": (1, None, _lesser(F.greatest)),
    "round": (1, 1, _whole(lambda x: F.floor(x + 0.5))),
    "floor": (1, 1, _whole(F.floor)),
    "ceil": (1, 1, _whole(F.ceil)),
    "pow": (2, 2, F.pow),
    "log": (1, 1, F.log),
    "log10": (1, 1, F.log10),
    "exp": (1, 1, F.exp),
}


@dataclass
class _Reader:
    """Reads a formula by how tightly its signs bind and builds the expression on the way."""

    source: str
    kinds: dict[str, str]
    aliases: dict[str, Column]
    texts: bool
    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    at: int = 0
    reads: list[str] = field(default_factory=list)
    divides: bool = False

    def split(self) -> None:
        place = 0
        end = len(self.source.rstrip())
        while place < end:
            m = _TOKEN.match(self.source, place)
            if not m:
                place += len(self.source[place:]) - len(self.source[place:].lstrip())
                what = {"'": "text is never closed", '"': "text is never closed", "[": "[ is never closed"}.get(self.source[place], f"{self.source[place]!r} has no meaning here")
                raise FormulaError(what, place + 1)
            kind = m.lastgroup
            word = m[kind]
            if kind == "name" and word.lower() in ("and", "or", "not"):
                kind, word = "sign", word.lower()
            self.tokens.append((kind, _SAME.get(word, word) if kind == "sign" else word, m.start(kind) + 1))
            place = m.end()
        self.tokens.append(("end", "", end + 1))

    def sign(self, *words: str) -> bool:
        """Steps over one of these signs."""
        kind, word, _ = self.tokens[self.at]
        if kind == "sign" and word in words:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.sign(word):
            raise FormulaError(f"{word!r} is missing", self.tokens[self.at][2])

    def expression(self, least: int = 0) -> Value:
        left = self.operand()
        while True:
            kind, word, _ = self.tokens[self.at]
            binds = _BINDS.get(word, 0) if kind == "sign" else 0
            if binds <= least:
                return left
            self.at += 1
            # a power takes a signed value; comparisons don't chain, since what stands right of one binds tighter
            left = self.joined(word, left, self.expression(_SIGNED - 1 if word == "^" else binds))
            if binds == 4 and self.tokens[self.at][:1] == ("sign",) and _BINDS.get(self.tokens[self.at][1]) == 4:
                raise FormulaError("comparisons don't chain", self.tokens[self.at][2])

    def operand(self) -> Value:
        kind, word, place = self.tokens[self.at]
        self.at += 1
        if kind == "sign":
            if word == "(":
                inner = self.expression()
                self.need(")")
                return inner
            if word in ("+", "-"):
                x = self.expression(_SIGNED).number()
                return Value("number", -x if word == "-" else x, True)
            if word == "not":
                return Value("flag", ~self.expression(_NOT - 1).truth())
        if kind == "number":
            return Value("number", F.lit(float(word)), True)
        if kind == "text":
            if not self.texts:
                raise FormulaError("this formula must give a number, not text", place)
            return Value("text", F.lit(word[1:-1]))
        if kind == "name" and self.sign("("):
            return self.call(word, place)
        if kind in ("name", "quoted"):
            return self.named(word, place)
        raise FormulaError("the formula ends too early" if kind == "end" else f"{word!r} is unexpected", place)

    def named(self, name: str, place: int) -> Value:
        if name in self.aliases:
            self.reads.append(name)
            return Value("number", self.aliases[name])
        if name in self.kinds:
            self.reads.append(name)
            kind = self.kinds[name]
            column = F.col(f"`{name.replace('`', '``')}`")
            if kind in _NUMERIC or kind.startswith("decimal"):
                return Value("number", column.cast("double"), kind not in ("double", "float"))
            return Value("flag", column) if kind == "boolean" else Value("text", column.cast("string"))
        raise FormulaError(f"no column {name!r}", place)

    def call(self, name: str, place: int) -> Value:
        args: list[Value] = []
        if not self.sign(")"):
            args.append(self.expression())
            while self.sign(","):
                args.append(self.expression())
            self.need(")")
        if name.lower() == "if":
            if len(args) != 3:
                raise FormulaError("if() takes a condition and two values", place)
            return self.chosen(*args)
        if name not in FUNCTIONS:
            raise FormulaError(f"no function {name!r}", place)
        least, most, f = FUNCTIONS[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise FormulaError(f"{name}() doesn't take {len(args)} values", place)
        return Value("number", f(*(a.number() for a in args)), name in ("abs", "min", "max", "round", "floor", "ceil"))

    def chosen(self, condition: Value, yes: Value, no: Value) -> Value:
        c = condition.truth()
        pick = lambda a, b: F.when(c, a).when(~c, b)
        if yes.kind == no.kind:
            return Value(yes.kind, pick(yes.column, no.column), yes.finite and no.finite)
        if not self.texts:
            return Value("number", pick(yes.number(), no.number()), True)
        return Value("text", pick(yes.text(), no.text()))

    def joined(self, word: str, a: Value, b: Value) -> Value:
        if word in ("and", "or"):
            x, y = a.truth(), b.truth()
            return Value("flag", x & y if word == "and" else x | y)
        if _BINDS[word] == 4:
            return Value("flag", _compared(word, a, b))
        x, y = a.number(), b.number()
        self.divides |= word == "/"
        if word in "/%":
            y = F.nullif(y, F.lit(0.0))
        done = x + y if word == "+" else x - y if word == "-" else x * y if word == "*" else x / y if word == "/" else x % y if word == "%" else F.pow(x, y)
        return Value("number", done)


def _compared(word: str, a: Value, b: Value) -> Column:
    test = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q, "=": lambda p, q: p == q, "!=": lambda p, q: p != q}[word]
    if a.kind == b.kind == "number":
        return test(a.number(), b.number())
    x, y = a.number(), b.number()
    s, t = F.lower(F.trim(a.text())), F.lower(F.trim(b.text()))
    given = F.lit(True)
    for v in (a, b):
        given = given & (v.number().isNotNull() if v.kind == "number" else F.coalesce(v.text() != "", F.lit(False)))
    return F.when(given, F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(s, t)))


@dataclass
class Formula:
    """A compiled formula: its ``column``, the columns it ``reads``, whether it ``divides``."""

    source: str
    column: Column
    kind: str
    reads: list[str]
    divides: bool


def compiled(source: str, rows: DataFrame, texts: bool = False, aliases: dict[str, Column] | None = None) -> Formula:
    """A formula over the columns of ``rows`` (and ``aliases``, which go first); raises FormulaError before any row is read.

    With ``texts`` it may give text or a flag, else it gives a number: a bare comparison 1 or 0.
    """
    reader = _Reader(source, dict(rows.dtypes), aliases or {}, texts)
    reader.split()
    if len(reader.tokens) == 1:
        raise FormulaError("the formula is empty", 1)
    value = reader.expression()
    if reader.tokens[reader.at][0] != "end":
        raise FormulaError(f"{reader.tokens[reader.at][1]!r} stands behind the end", reader.tokens[reader.at][2])
    if texts:
        column = F.nullif(value.column, F.lit("")) if value.kind == "text" else value.number() if value.kind == "number" else value.column
    else:
        column = value.column.cast("double") if value.kind == "flag" else value.number()
    return Formula(source, column, value.kind, list(dict.fromkeys(reader.reads)), reader.divides)


def calculate(rows: DataFrame, formulas: dict[str, str], texts: bool = False) -> DataFrame:
    """``rows`` with a column for each formula; all read the columns as they were."""
    return rows.withColumns({name: compiled(f, rows, texts).column for name, f in formulas.items()})


# calculated elements of assay tables


def oxides(units: dict[str, str]) -> dict[str, Column]:
    """Oxide names a formula may use for elements that are stored as such: ``SiO2`` reads Si by its factor."""
    names = {"Si": "SiO2", "Al": "Al2O3", "Fe": "Fe2O3", "Mg": "MgO", "Ca": "CaO", "Na": "Na2O", "K": "K2O", "Ti": "TiO2", "P": "P2O5", "Mn": "MnO"}
    return {names[e]: F.col(e) * OXIDE_FACTOR[e] for e in units if e in names and names[e] not in units}


def mixed_units(formula: Formula, units: dict[str, str]) -> bool:
    """A ratio of plain concentrations that are stored in more than one unit."""
    kinds = {("ppm" if units[c] == "g/t" else units[c]) for c in formula.reads if c in units}
    return formula.divides and len(formula.reads) > 1 and all(units.get(c) in UNIT_PPM for c in formula.reads) and len(kinds) > 1


def calculated_element(assays: DataFrame, name: str, source: str, units: dict[str, str], read_in: dict[str, str] | None = None) -> DataFrame:
    """``assays`` with a new element ``name``, its qualifier ``name_q`` and ``name_why`` where it has no value.

    ``units``: the unit of each element column; ``read_in``: the units that the formula wants some of them in.
    A qualifier column ``<element>_q`` holds "<" below detection: a ratio with such an operand has no value (why:
    "below detection"); any other formula whose operands are all below keeps "<". A row without some
    operand is "missing"; one with all of them and no finite result is "no number".
    """
    if name in units:
        raise ValueError(f"{name} exists")
    for element, unit in (read_in or {}).items():
        if units[element] not in UNIT_PPM or unit not in UNIT_PPM:
            raise ValueError(f"{element} is stored in {units[element]}, which can't be read in {unit}")
    named = oxides(units)
    of = {o: e for e in units for o in oxides({e: ""}) if o in named}
    f = compiled(source, assays, aliases=named | {e: F.col(e).cast("double") * (UNIT_PPM[units[e]] / UNIT_PPM[u]) for e, u in (read_in or {}).items()})
    operands = list(dict.fromkeys(of.get(c, c) for c in f.reads))
    some, every, whole = F.lit(False), F.lit(bool(operands)), F.lit(bool(operands))
    for c in operands:
        below = F.coalesce(F.col(f"{c}_q") == "<", F.lit(False)) if f"{c}_q" in assays.columns else F.lit(False)
        some, every = some | below, every & below
        whole = whole & Value("text", F.col(c).cast("string")).number().isNotNull()
    barred = some & F.lit(f.divides)
    value = F.when(~barred, f.column)
    why = F.when(barred, "below detection").when(f.column.isNotNull(), None).when(whole, "no number").otherwise("missing")
    return assays.withColumns({name: value, f"{name}_q": F.when(value.isNotNull() & every, "<"), f"{name}_why": why})


def outcome(calculated: DataFrame, name: str) -> DataFrame:
    """One row: how many rows have a value, a "<", none and why, and the range."""
    why = lambda w: F.count_if(F.coalesce(F.col(f"{name}_why") == w, F.lit(False)))
    return calculated.agg(F.count(name).alias("computed"), F.count(f"{name}_q").alias("flagged"), why("missing").alias("missing"), why("no number").alias("no_number"), why("below detection").alias("below"), F.min(name).alias("least"), F.max(name).alias("most"))


def signatures(rows: DataFrame, sources: Iterable[str]) -> dict[str, str]:
    """A signature of each formula's inputs: the rows' number and all operands' values, in any order, in one scan.

    Values count to a millionth. A formula whose signature has changed since is stale.
    """
    marks = {}
    for i, source in enumerate(sources):
        reads = sorted(compiled(source, rows, True).reads)
        cells = [F.floor(F.col(f"`{c}`").cast("double") * 1e6 + 0.5).cast("string") if dict(rows.dtypes)[c] != "string" else F.col(f"`{c}`") for c in reads]
        marks[source] = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.xxhash64(*[F.coalesce(c, F.lit("\x00")) for c in cells], F.lit(len(cells))).cast("decimal(38,0)")), F.lit(0)).cast("string"), F.lit(",".join(reads))).alias(f"s{i}")
    row = rows.agg(*marks.values()).first()
    return dict(zip(marks, row))


def stale(rows: DataFrame, made: dict[str, tuple[str, str]]) -> list[str]:
    """Of calculated columns (name -> formula and the signature it was made with) those whose inputs have changed."""
    now = signatures(rows, [f for f, _ in made.values()])
    return [name for name, (f, mark) in made.items() if now[f] != mark]


def block_formula(models: dict[str, DataFrame], source: str, step: float = 1e-3) -> DataFrame:
    """A block model whose value is a formula over models on one lattice: ``x, y, z, value, inputs``.

    Each model has ``x, y, z, value`` and is named in the formula by its key. A block that lacks some input of the formula, or
    that the formula gives no number for, has a null value; ``inputs`` is how many of the formula's inputs it has. Models
    meet by one grouping on the lattice's cells; where a model has several blocks in a cell, the
    least value counts.
    """
    parts = None
    for name, m in models.items():
        v = F.col("value").cast("double")
        one = m.where(v.isNotNull() & ~F.isnan(v)).select("x", "y", "z", *(F.floor(F.col(a) / step + 0.5).alias(f"__k{a}") for a in "xyz"), F.lit(name).alias("__model"), v.alias("__v"))
        parts = one if parts is None else parts.unionByName(one)
    cells = parts.groupBy("__kx", "__ky", "__kz").agg(*(F.min(a).alias(a) for a in "xyz"), *(F.min(F.when(F.col("__model") == n, F.col("__v"))).alias(n) for n in models))
    f = compiled(source, cells.select(*models))
    if not f.reads:
        raise FormulaError("the formula reads no model", 1)
    held = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in f.reads), F.lit(0))
    return cells.select("x", "y", "z", F.when(held == len(f.reads), f.column).alias("value"), held.alias("inputs")).where("inputs > 0")
