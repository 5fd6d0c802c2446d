"""Linking records of two sources that share no key: days and names of any spelling.

Rows that agree in day and normalized names are one class of their source.
Names of Dice similarity ``least`` have one of their rarest q-grams in common,
so no pair above the threshold is missed if names meet on these.  Names are
compared once, however many days they stand on; classes of nearby days then
look their names up.  Rows are assigned one to one: in every round the class
pairs that are best for both sides give each other as many rows as both have
left, in the order of their ids.  This goes by bands of the score, best first:
what a band has used up needs no pairs in the bands below, of which there would
be far more, as many records of a day are a little similar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .names import named

#: Characters that a q-gram has.
Q = 3
#: Pairs for each class that the first band of scores has, about; each band has twice as many as the one before, and fewer classes are open.
BAND_PAIRS = 4
#: Classes that a name has on average from which on names are compared once for all days.
REPEATED = 4


@dataclass(frozen=True)
class Source:
    """Where the records of one source have their id, their day and their names."""

    rows: DataFrame
    id: str
    day: str
    names: tuple[str, ...]


def normalized(name: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def name_grams(names: Sequence[Column], q: int = Q) -> Column:
    """Distinct q-grams of normalized names, which are padded by a # on both sides; each gram with the number of its name."""

    def of_name(i: int, name: Column) -> Column:
        padded = F.concat(F.lit("#"), F.coalesce(name, F.lit("")), F.lit("#"))
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (q - 1), F.lit(1)))
        found = F.transform(starts, lambda s: F.concat(F.lit(f"{i}:"), F.substring(padded, s, F.lit(q))))
        return F.when(F.char_length(padded) > 2, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_name(i, name) for i, name in enumerate(names)]))


def _classes(source: Source, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (l, day, l_name, l_n, l_first, l_from), names (l_name, grams) and members (day, names, nth, id) of side "l"; "r" likewise.

    Records without an id, a day or a name are in none.  Numbers of classes follow the order of their days and names.
    """
    texts = [F.coalesce(normalized(named(c).cast("string")), F.lit("")) for c in source.names]
    rows = source.rows.select(named(source.id).alias("id"), named(source.day).cast("date").alias("day"), F.array(*texts).alias("names"))
    rows = rows.where(F.col("id").isNotNull() & F.col("day").isNotNull() & F.exists("names", lambda n: n != ""))
    # The order of ids is within a class, so that a day with very many records is not one task's.
    nth = F.row_number().over(Window.partitionBy("day", "names").orderBy("id")).cast("long")
    members = kept(rows.select("day", "names", nth.alias("nth"), "id"), "members")
    groups = members.groupBy("day", "names").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    numbered = kept(groups.orderBy("day", "names").withColumn("class", F.monotonically_increasing_id()), "numbered")
    grams = name_grams([F.col("names")[i] for i in range(len(source.names))])
    names = kept(numbered.select("names").distinct().select("names", grams.alias("grams"), F.monotonically_increasing_id().alias(f"{side}_name")), "names")
    about = {"class": side, "n": f"{side}_n", "first": f"{side}_first"}
    classes = numbered.join(names.select("names", f"{side}_name"), "names")
    classes = kept(classes.select("day", "names", f"{side}_name", *[F.col(c).alias(to) for c, to in about.items()], F.lit(0).cast("long").alias(f"{side}_from")), "classes")
    drop_kept(numbered)
    return classes, names.select(f"{side}_name", "grams"), members


def _prefixes(names: DataFrame, name: str, often: DataFrame, least: float) -> DataFrame:
    """(name, gram): the rarest grams of each, so many that similar names have one of them."""
    ranked = names.select(name, F.explode("grams").alias("gram")).join(often, "gram").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("ranked"))
    n = F.size("ranked")
    # Of n grams similar names have least / (2 - least) or more; a millionth guards against rounding.
    shared = F.ceil(n * F.lit(least / (2 - least)) - F.lit(1e-6)).cast("int")
    chosen = F.slice("ranked", F.lit(1), n - F.greatest(shared, F.lit(1)) + 1)
    return ranked.select(name, F.explode(F.transform(chosen, lambda g: g["gram"])).alias("gram"))


def _nearby(tolerance: int) -> Column:
    return F.explode(F.sequence(F.date_sub("day", tolerance), F.date_add("day", tolerance))).alias("day")


def similar_names(left: DataFrame, right: DataFrame, lc: DataFrame, rc: DataFrame, tolerance: int, least: float) -> DataFrame:
    """(l_name, r_name, score) of names of Dice similarity ``least`` or more."""
    grams = left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram")))
    often = kept(grams.groupBy("gram").agg(F.count("*").alias("often")), "grams")
    a, b, on = _prefixes(left, "l_name", often, least), _prefixes(right, "r_name", often, least), ["gram"]
    if lc.count() + rc.count() < REPEATED * (left.count() + right.count()):
        # Most names stand on few days: only those of nearby days meet.
        a, b, on = a.join(lc.select("l_name", "day"), "l_name").select("l_name", "gram", _nearby(tolerance)), b.join(rc.select("r_name", "day"), "r_name"), ["day", "gram"]
    met = a.join(b, on).select("l_name", "r_name").distinct()
    met = met.join(left.withColumnRenamed("grams", "lg"), "l_name").join(right.withColumnRenamed("grams", "rg"), "r_name")
    score = 2.0 * F.size(F.array_intersect("lg", "rg")) / (F.size("lg") + F.size("rg"))
    return kept(met.select("l_name", "r_name", score.alias("score")).where(F.col("score") >= least), "similar")


def _hundredth() -> Column:
    return F.floor(F.col("score") * 100)


def _bands(similar: DataFrame, lc: DataFrame, rc: DataFrame, tolerance: int) -> list[int]:
    """Least hundredths of the score of each band, best band first, by how many class pairs names have if days are alike."""
    days = max(1, lc.select("day").distinct().count())
    of = lambda classes, s: classes.groupBy(f"{s}_name").agg(F.count("*").alias(f"{s}_days"))
    weight = F.sum(F.col("l_days") * F.col("r_days")) * (2 * tolerance + 1) / days
    counted = similar.join(of(lc, "l"), "l_name").join(of(rc, "r"), "r_name").groupBy(_hundredth().alias("at")).agg(weight.alias("pairs"))
    edges, held, most = [], 0.0, float(BAND_PAIRS * (lc.count() + rc.count()))
    for row in sorted(counted.collect(), key=lambda r: -r["at"]):  # 101 rows at most
        if edges and held + row["pairs"] > most:
            held, most = 0.0, 2 * most
        if held == 0:
            edges.append(row["at"])
        edges[-1], held = row["at"], held + row["pairs"]
    return edges


def _rounds(open_: DataFrame, number: int) -> list[DataFrame]:
    """(l, r, l_from, r_from, n, score, round) in frames: which of the class pairs give each other how many rows, from which on.

    Pairs (l, r, score, l_n, r_n, l_first, r_first, l_from, r_from) have one
    order: higher score, then smaller ids.  The result is that of going through
    them in this order and letting each take what is left; a round does so for
    all pairs at once that are first for both their sides.
    """
    order = [F.desc("score"), F.col("l_first"), F.col("r_first"), F.col("l"), F.col("r")]
    zero, made = F.lit(0).cast("long"), []
    while not open_.isEmpty():
        number += 1
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(*order))
        ranked = open_.select("*", best("l").alias("l_place"), best("r").alias("r_place"))
        taken = kept(ranked.where("l_place = 1 and r_place = 1").select("l", "r", "l_from", "r_from", F.least("l_n", "r_n").alias("n"), "score", F.lit(number).alias("round")), "taken")
        made.append(taken)
        rest = open_
        for side in "lr":
            rest = _left_over(rest, taken, side)
        rest = kept(rest.where("l_n > 0 and r_n > 0").select(open_.columns), "pairs")
        drop_kept(open_)
        open_ = rest
    drop_kept(open_)
    return made


def _left_over(rows: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    """``rows`` with what their classes of this side have left after ``taken``."""
    gone, less = taken.groupBy(side).agg(F.sum("n").alias("gone")), F.coalesce("gone", F.lit(0).cast("long"))
    return rows.join(gone, side, "left").withColumns({f"{side}_n": F.col(f"{side}_n") - less, f"{side}_from": F.col(f"{side}_from") + less}).drop("gone")


def assign(lc: DataFrame, rc: DataFrame, similar: DataFrame, tolerance: int) -> DataFrame | None:
    """All that ``_rounds`` gives for the classes of nearby days with similar names, by bands of the score; None if there is none.

    The best pair of a class is never in a band below, so the bands one after
    another give what all pairs at once do, with pairs of open classes only.
    """
    l_open, r_open, made, top = lc.drop("names"), rc.drop("names"), [], 101
    for least in _bands(similar, lc, rc, tolerance):
        names = similar.where((_hundredth() >= least) & (_hundredth() < top))
        near = l_open.select("l", "l_name", "l_n", "l_first", "l_from", _nearby(tolerance))
        pairs = kept(near.join(names, "l_name").join(r_open, ["day", "r_name"]).select("l", "r", "score", "l_n", "r_n", "l_first", "r_first", "l_from", "r_from"), "pairs")
        found = _rounds(pairs, len(made))
        made, top = made + found, least
        if found:
            taken = reduce(DataFrame.unionByName, found)
            l_open, r_open = (kept(_left_over(rows, taken, s).where(f"{s}_n > 0"), "open") for rows, s in ((l_open, "l"), (r_open, "r")))
    return reduce(DataFrame.unionByName, made) if made else None


def link_records(left: Source, right: Source, tolerance: int = 1, least: float = 0.6) -> DataFrame:
    """(left_id, right_id, score, round): which records of two sources are the same, one to one; rounds are numbered through all bands.

    Records pair up if their days are at most ``tolerance`` apart and their
    names have Dice similarity ``least`` or more over q-grams; better scores
    first, ties by smaller ids.  Records without an id, a day or a name are left
    out, and those without a partner.  Repeated records pair off with repeated
    records, in the order of their ids.
    """
    if not 0 < least <= 1 or len(left.names) != len(right.names):
        raise ValueError("similarity must be over 0 and at most 1, and both sources need as many names")
    (lc, ln, lm), (rc, rn, rm) = _classes(left, "l"), _classes(right, "r")
    given = assign(lc, rc, similar_names(ln, rn, lc, rc, tolerance, least), tolerance)
    of = lambda members, classes, s: members.join(classes.select("day", "names", s), ["day", "names"]).select(s, F.col("nth").alias(f"{s}_nth"), F.col("id").alias("left_id" if s == "l" else "right_id"))
    if given is None:
        return of(lm, lc, "l").join(of(rm, rc, "r"), F.lit(False)).select("left_id", "right_id", F.lit(0.0).alias("score"), F.lit(0).alias("round"))
    # One row for each pair of records.
    each = given.select("l", "r", "score", "round", "l_from", "r_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    each = each.select("l", "r", "score", "round", (F.col("l_from") + F.col("k")).alias("l_nth"), (F.col("r_from") + F.col("k")).alias("r_nth"))
    return each.join(of(lm, lc, "l"), ["l", "l_nth"]).join(of(rm, rc, "r"), ["r", "r_nth"]).select("left_id", "right_id", "score", "round")
