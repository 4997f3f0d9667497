"""Scoring extracted records against a curated key: pairs, one-to-one matching, labels, precision and recall."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import penalties as P
from ..functions.numerics import assignment, closest_first, closest_pairs, sparse_assignment
from ..functions.rules import normalised
from ..storage import stored
from . import scan
from .graph import components

#: Cost of a pair whose names do not agree: finite, so that every record can be assigned.
GATE_COST = 10.0
#: Pairs that the matcher holds at once, a larger group apart.
PAIRS = 200_000
#: Pairs up to which a group is not split into connected parts.
TOGETHER = 10_000
#: Partitions of a tolerance join, and what it deals rows by beside the keys.
PARTS = 400
_CELL = ("__a", "__b", "__field", "__bucket")


def pairs(curated: DataFrame, extracted: DataFrame, group: str, index: str, name: str, numbers: Sequence[str], names: Sequence[str] = (), gate: float = P.GATE, tolerance: float = P.TOLERANCE, ratio: bool = True) -> DataFrame:
    """(group, i, j, gate, penalty, cost, wrong): all pairs of a group with the mean penalty over the fields.

    ``name`` is compared by string ratio against ``gate`` (or for equality), ``names`` for equality, ``numbers``
    by tolerance.  ``wrong`` lists the fields whose penalty is 1.
    """
    left = curated.select(F.col(group), F.col(index).alias("i"), *(F.col(c).alias(f"c_{c}") for c in (name, *names, *numbers)))
    right = extracted.select(F.col(group), F.col(index).alias("j"), *(F.col(c).alias(f"e_{c}") for c in (name, *names, *numbers)))
    both = left.join(right, group)
    if ratio:
        both = P.with_string_ratio(both, f"c_{name}", f"e_{name}")
        agree = F.col("ratio") >= gate
    else:
        agree = F.col(f"c_{name}").eqNullSafe(F.col(f"e_{name}"))
    parts: dict[str, Column] = {name: F.when(agree, 0.0).otherwise(1.0)}
    parts |= {c: P.equality(F.col(f"c_{c}"), F.col(f"e_{c}")) for c in names}
    parts |= {c: P.numeric(F.col(f"c_{c}"), F.col(f"e_{c}"), tolerance) for c in numbers}
    mean = sum(parts.values(), F.lit(0.0)) / len(parts)
    wrong = F.array_compact(F.array(*(F.when(v >= 1.0, F.lit(k)) for k, v in parts.items())))
    return both.select(group, "i", "j", agree.alias("gate"), mean.alias("penalty"), F.when(agree, mean).otherwise(GATE_COST).alias("cost"), wrong.alias("wrong"))


def uncontested(groups: np.ndarray, i: np.ndarray, j: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of chosen pairs, groups left): groups in which each record of the smaller side can have its cheapest partner."""
    if not len(groups):
        return np.empty(0, int), np.empty(0, int)

    def best(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, costs, own, groups))
        g, o = groups[order], own[order]
        first = order[np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]))]
        by = np.lexsort((other[first], groups[first]))
        same = (groups[first][by][1:] == groups[first][by][:-1]) & (other[first][by][1:] == other[first][by][:-1])
        return first, np.bincount(groups[first], minlength=n), np.unique(groups[first][by][1:][same])

    n = int(groups.max()) + 1
    (rows, n_rows, row_clash), (columns, n_columns, column_clash) = best(i, j), best(j, i)
    wide = n_rows <= n_columns
    clash = np.zeros(n, bool)
    clash[row_clash[wide[row_clash]]] = True
    clash[column_clash[~wide[column_clash]]] = True
    take = lambda x, side: x[side[groups[x]] & ~clash[groups[x]]]
    return np.concatenate([take(rows, wide), take(columns, ~wide)]), np.flatnonzero(clash)


def _chosen(pair_table: DataFrame, keys: Sequence[str], solve) -> DataFrame:
    """The rows of ``pair_table`` that ``solve`` (i, j, costs → places) chooses for each value of ``keys``.

    A window deals pairs to tasks by the keys and sorts them; they stream through, so a task holds one group and one batch.
    """
    fields = pair_table.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            table = pa.Table.from_batches(held if b is None else [*held, b]) if held or b is not None else None
            if table is None or not len(table):
                continue
            rows = table.combine_chunks().to_batches()[0]
            column = lambda c: rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            i, j, costs = (column(c) for c in ("i", "j", "cost"))
            new = np.zeros(len(i) - 1, bool)
            for c in keys:
                own = column(c)
                new |= own[1:] != own[:-1]
            starts = np.append(0, np.flatnonzero(new) + 1)
            ends = np.append(starts[1:], len(i))
            whole = len(starts) if b is None else len(starts) - 1  # the last group may go on in the next batch
            last = ends[whole - 1] if whole else 0
            chosen, hard = uncontested(np.repeat(np.arange(whole), (ends - starts)[:whole]), i[:last], j[:last], costs[:last])
            chosen = [*chosen, *(starts[g] + k for g in hard for k in solve(i[starts[g] : ends[g]], j[starts[g] : ends[g]], costs[starts[g] : ends[g]]))]
            held = [rows.slice(starts[-1])] if whole < len(starts) else []
            yield rows.take(pa.array(chosen, pa.int64())).select(fields.names)

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("i", "j"))
    return pair_table.withColumn("__place", place).mapInArrow(run, fields)


def matched(pair_table: DataFrame, group: str, greedy: bool = False) -> DataFrame:
    """The pairs of a least-cost one-to-one assignment in each group (or closest first); ties to low indices.

    Pairs that come straight from a join on the group stay where they are; after the string ratio, which runs in
    Python, Spark no longer knows where they are and shuffles them once.  A group is held as a matrix of all its records;
    ``sparse_matched`` holds only pairs that are given.
    """

    def solve(i: np.ndarray, j: np.ndarray, costs: np.ndarray) -> list[int]:
        rows, columns = np.unique(i), np.unique(j)
        at_row, at_column = np.searchsorted(rows, i), np.searchsorted(columns, j)
        cost, place = np.full((len(rows), len(columns)), GATE_COST), np.full((len(rows), len(columns)), -1)
        cost[at_row, at_column], place[at_row, at_column] = costs, np.arange(len(i))
        return [place[x] for x in (closest_first if greedy else assignment)(cost) if place[x] >= 0]

    return _chosen(pair_table.filter(F.col(group).isNotNull()), [group], solve)


def gated_pairs(curated: DataFrame, extracted: DataFrame, group: str, index: str, name: str, numbers: Sequence[str], tolerance: float = P.TOLERANCE) -> DataFrame:
    """(group, i, j, penalty, cost): the pairs of a group whose names are equal (nulls too), by a join on both, with the mean
    penalty over the name and ``numbers``.  Records of other names never meet."""
    left = curated.select(group, F.col(index).alias("i"), F.col(name).alias("__name"), *(F.col(c).alias(f"c_{c}") for c in numbers))
    right = extracted.select(F.col(group).alias("__group"), F.col(index).alias("j"), F.col(name).alias("__other"), *(F.col(c).alias(f"e_{c}") for c in numbers))
    met = left.join(right, (F.col(group) == F.col("__group")) & F.col("__name").eqNullSafe(F.col("__other")))
    mean = sum((P.numeric(F.col(f"c_{c}"), F.col(f"e_{c}"), tolerance) for c in numbers), F.lit(0.0)) / (len(numbers) + 1)
    return met.select(group, "i", "j", mean.alias("penalty")).withColumn("cost", F.col("penalty"))


def sparse_matched(gated: DataFrame, group: str, split: bool = False, skip: float = GATE_COST) -> DataFrame:
    """The rows of ``gated`` (group, i, j, cost, ...; each pair once) in a least-cost one-to-one matching of each group, where
    records that are left over cost ``skip``: what ``matched`` finds with all other pairs at that cost, without holding them.

    ``split``: connected parts of groups of more than ``TOGETHER`` pairs are found by Spark first and solved apart, so a group
    with most of the pairs spreads over tasks; smaller ones, and all without it, are solved whole in the task that holds them.
    """
    known = gated.filter(F.col(group).isNotNull())

    def solve(i: np.ndarray, j: np.ndarray, costs: np.ndarray) -> list[int]:
        return sparse_assignment(i, j, costs, skip)

    large = stored(known.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > TOGETHER).select(group)) if split else None
    if large is None or large.isEmpty():
        return _chosen(known, [group], solve)
    whole = _chosen(known.join(large, group, "left_anti"), [group], solve)
    known = known.join(large, group, "left_semi")
    # two nodes of one hash would only join two parts, which is solved right as well
    node = lambda side, at: F.xxhash64(F.col(group), F.lit(side), F.col(at))
    parts = components(known.select(node("i", "i").alias("a"), node("j", "j").alias("b"))).withColumnRenamed("part", "__part")
    dealt = known.withColumn("__node", node("i", "i")).join(parts.withColumnRenamed("node", "__node"), "__node").drop("__node")
    return whole.unionByName(_chosen(dealt, ["__part", group], solve).drop("__part"))


def paired_rest(curated: DataFrame, extracted: DataFrame, assigned: DataFrame, group: str, index: str) -> DataFrame:
    """(group, i, j): records that ``assigned`` leaves over on both sides of a group, paired in the order of their indices."""
    def left_over(df: DataFrame, at: str) -> DataFrame:
        rest = df.select(group, F.col(index).alias(at)).join(assigned.select(group, at), [group, at], "left_anti")
        return scan.positions(rest, [group], [at], "__k")

    return left_over(curated, "i").join(left_over(extracted, "j"), [group, "__k"]).drop("__k")


def labels(curated: DataFrame, extracted: DataFrame, assigned: DataFrame, group: str, index: str, accept: float = P.ACCEPT, documents: DataFrame | None = None) -> DataFrame:
    """(group, verdict, i, j, penalty, reason, wrong): TP, MISMATCH, FN and FP of the groups that were extracted.

    ``documents``: the groups that were extracted, those without any record included, whose curated records are all FN;
    without it a group counts as extracted if it has a record.
    Records and both sides of each pair meet in one grouping by (group, side, position), so the matching runs once.
    """
    kind = "struct<gate:boolean,penalty:double,j:bigint,wrong:array<string>>"
    info = F.struct("gate", "penalty", F.col("j").cast("long").alias("j"), "wrong")
    side = lambda name, place, what: F.struct(F.lit(name).alias("side"), F.col(place).cast("long").alias("place"), what.cast(kind).alias("info"))
    none = F.lit(None)
    met = assigned.select(group, F.explode(F.array(side("i", "i", info), side("j", "j", none))).alias("m")).select(group, "m.*", F.lit(True).alias("met"))
    seen = (extracted if documents is None else documents).select(group).distinct()
    left = curated.join(seen, group, "left_semi").select(group, side("i", index, none).alias("m")).select(group, "m.*", F.lit(False).alias("met"))
    right = extracted.select(group, side("j", index, none).alias("m")).select(group, "m.*", F.lit(False).alias("met"))
    rows = met.unionByName(left).unionByName(right).groupBy(group, "side", "place").agg(F.first("info", ignorenulls=True).alias("info"), F.max("met").alias("met"))
    first, pair = F.col("side") == "i", F.col("info")
    good = pair["gate"] & (pair["penalty"] < accept)
    verdict = F.when(~F.col("met"), F.when(first, "FN").otherwise("FP")).when(good, "TP").otherwise("MISMATCH")
    reason = F.when(~F.col("met"), "no counterpart").when(good, none).when(~pair["gate"], "names differ").otherwise("numbers differ")
    return rows.filter(first | ~F.col("met")).select(
        group, verdict.alias("verdict"), F.when(first, F.col("place")).alias("i"), F.when(first, pair["j"]).otherwise(F.col("place")).alias("j"),
        F.round(pair["penalty"], 4).alias("penalty"), reason.alias("reason"), F.coalesce(pair["wrong"], F.array().cast("array<string>")).alias("wrong"),
    )


def totals(label_table: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over the labels; a rejected pair is one false of each kind."""
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    out = label_table.groupBy(*by).agg(count("TP").alias("tp"), count("MISMATCH", "FP").alias("fp"), count("MISMATCH", "FN").alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def _assigned(curated: DataFrame, extracted: DataFrame, group: str, index: str, name: str, numbers: Sequence[str], names: Sequence[str], gate: float, tolerance: float, ratio: bool, documents: DataFrame | None = None, greedy: bool = False) -> DataFrame:
    """(group, i, j, sum, bits, gate): the pairs of an assignment of each group with the sum of their penalties and the fields but
    the name that are wrong, and the records that it leaves over, without a partner; ``greedy``: closest first, and pairs alone.

    The sides meet once, by a join of a list of records a group: pairs exist inside the matcher only, so none is sent or sorted.
    """
    k = 1 + len(names) + len(numbers)
    kinds = {c: (dict(curated.dtypes)[c], dict(extracted.dtypes)[c]) for c in names}

    def text(c: str) -> Column:
        """The field as text that is equal where the fields are."""
        if kinds[c][0] == kinds[c][1] == "string":
            return F.col(c)
        if kinds[c][0] != kinds[c][1] and "string" not in kinds[c] or {*kinds[c]} & {"double", "float"}:
            return (F.col(c).cast("double") + 0.0).cast("string")
        return F.col(c).cast("string")

    def records(df: DataFrame, at: str) -> DataFrame:
        """A row a group, with its records as a list."""
        label = normalised(F.col(name)) if ratio else F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))
        own = [F.col(index).cast("long").alias("at"), label.alias("name"), *(text(c).alias(f"t{n}") for n, c in enumerate(names)), *(F.col(c).cast("double").alias(f"n{n}") for n, c in enumerate(numbers))]
        return df.groupBy(F.col(group).alias(at)).agg(F.collect_list(F.struct(*own)).alias(f"{at}_list"))

    left, right = records(curated, "__g"), records(extracted, "__h")
    same = F.col("__g") == F.col("__h")
    if greedy:
        both = left.join(right, same).withColumnRenamed("__h", group)
    elif documents is None:  # a group without an extracted record was not extracted
        both = left.join(right, same, "right_outer").withColumnRenamed("__h", group)
    else:
        left = left.join(documents.select(F.col(group).alias("__g")).distinct(), "__g", "left_semi")
        both = left.join(right, same, "full_outer").withColumn(group, F.coalesce("__g", "__h"))
    rows = both.select(group, "__g_list", "__h_list")
    kept = S.StructType([S.StructField(group, rows.schema[group].dataType), S.StructField("i", S.LongType()), S.StructField("j", S.LongType()), S.StructField("sum", S.DoubleType()), S.StructField("bits", S.LongType()), S.StructField("gate", S.BooleanType())])

    def side(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        """Records of the lists in the order of their groups and positions, how many each group has, and their positions."""
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        at = pc.struct_field(flat, "at")
        held = np.repeat(np.arange(len(n)), n)
        known = ~at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((place, held))
        order = order[known[order]]
        return flat.take(pa.array(order)), np.bincount(held[order], minlength=len(n)), place[order]

    def nearest(costs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first cheapest place of each run of ``costs``."""
        hit = np.flatnonzero(costs == np.repeat(np.minimum.reduceat(costs, starts), sizes))
        return hit[np.searchsorted(hit, starts)]

    def solved(b: pa.RecordBatch, ratios: P.Ratios) -> pa.RecordBatch:
        (xs, n_left, at_left), (ys, n_right, at_right) = side(b.column(1)), side(b.column(2))
        many = n_left * n_right
        begin, first_left, first_right = (np.cumsum(v) - v for v in (many, n_left, n_right))
        of_left, of_right = (np.repeat(np.arange(len(many)), n) for n in (n_left, n_right))
        coded = lambda c: pa.concat_arrays([pc.struct_field(xs, c), pc.struct_field(ys, c)]).dictionary_encode()
        label = coded("name")
        code, values = label.indices.to_numpy(zero_copy_only=False).astype(np.int64), label.dictionary.to_pylist()
        texts = [coded(f"t{n}").indices.fill_null(-1).to_numpy(zero_copy_only=False) for n in range(len(names))]
        known = [[(v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)) for v in (pc.struct_field(xs, f"n{n}"), pc.struct_field(ys, f"n{n}"))] for n in range(len(numbers))]

        def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            p, q = code[x], code[len(xs) + y]
            if not ratio:
                return p == q
            seen, of = np.unique(p * len(values) + q, return_inverse=True)
            return np.array([r >= gate for r in ratios.of(*([values[v] for v in w] for w in np.divmod(seen, max(1, len(values)))))], bool)[of]

        def apart(x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The sum of the penalties of pairs, added up as ``pairs`` does, and the fields but the name that are wrong."""
            total, bits = np.where(agree, 0.0, 1.0), np.zeros(len(x), np.int64)
            for n in range(k - 1):
                if n < len(names):
                    penalty = (texts[n][x] != texts[n][len(xs) + y]).astype(float)
                else:
                    (u, no_u), (v, no_v) = known[n - len(names)]
                    penalty = P.numeric_of(u[x], no_u[x], v[y], no_v[y], tolerance)
                total += penalty
                bits |= (penalty >= 1.0).astype(np.int64) << n
            return total, bits

        def met(a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Groups and records of the pairs from place ``a`` up to ``z``."""
            place = np.arange(a, z)
            groups = np.searchsorted(begin + many, place, "right")
            step = place - begin[groups]
            return groups, first_left[groups] + step // n_right[groups], first_right[groups] + step % n_right[groups]

        def cheapest_first() -> tuple[np.ndarray, ...]:
            """Closest first: only names that agree cost less than GATE_COST, all other pairs cost as much, so what is left over pairs up in order."""
            near = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for a in range(0, int(many.sum()), PAIRS):
                _, x, y = met(a, min(a + PAIRS, int(many.sum())))
                agree = agreeing(x, y)
                x, y = x[agree], y[agree]
                near.append((x, y, apart(x, y, np.ones(len(x), bool))[0] / k))
            x, y, costs = map(np.concatenate, zip(*near))
            took = closest_pairs(x, y, costs)
            x, y = x[took], y[took]
            single = [np.setdiff1d(np.arange(n), v, assume_unique=True) for n, v in ((len(xs), x), (len(ys), y))]
            own = [of[w] for of, w in zip((of_left, of_right), single)]
            n = [np.bincount(w, minlength=len(many)) for w in own]
            x_rest, y_rest = (w[np.arange(len(w)) - (np.cumsum(m) - m)[g] < np.minimum(*n)[g]] for w, m, g in zip(single, n, own))
            x, y, agree = np.append(x, x_rest), np.append(y, y_rest), np.repeat([True, False], [len(x), len(x_rest)])
            return x, y, *apart(x, y, agree), agree

        def least() -> tuple[np.ndarray, ...]:
            """A least-cost assignment of all records."""
            groups, x, y = met(0, int(many.sum()))
            step = np.arange(len(groups)) - begin[groups]
            agree = agreeing(x, y)
            total, bits = apart(x, y, agree)
            costs = np.where(agree, total / k, GATE_COST)
            # groups in which each record of the smaller side can have its cheapest partner
            wide = n_left <= n_right
            chosen, hard = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(groups):
                rows_, columns = np.flatnonzero(np.repeat(n_right, n_left)), np.flatnonzero(np.repeat(n_left, n_right))
                row_group, column_group = of_left[rows_], of_right[columns]
                of_row = nearest(costs, begin[row_group] + (rows_ - first_left[row_group]) * n_right[row_group], n_right[row_group])
                turned = begin[groups] + step % n_left[groups] * n_right[groups] + step // n_left[groups]
                of_column = turned[nearest(costs[turned], begin[column_group] + (columns - first_right[column_group]) * n_left[column_group], n_left[column_group])]
                picked = np.concatenate([of_row[wide[row_group]], of_column[~wide[column_group]]])
                partner = np.where(wide[groups[picked]], len(xs) + y[picked], x[picked])
                clash = np.zeros(len(many), bool)
                twice = np.bincount(partner, minlength=len(xs) + len(ys)) > 1
                clash[groups[picked][twice[partner]]] = True
                hard = np.flatnonzero(clash)
                chosen = picked[~clash[groups[picked]]]
            more = [begin[g] + r * n_right[g] + c for g in hard for r, c in assignment(costs[begin[g] : begin[g] + many[g]].reshape(n_left[g], n_right[g]))]
            chosen = np.concatenate([chosen, np.array(more, np.int64)])
            return x[chosen], y[chosen], total[chosen], bits[chosen], agree[chosen]

        x, y, total, bits, agree = cheapest_first() if greedy else least()
        free = [np.ones(len(xs), bool), np.ones(len(ys), bool)]
        free[0][x], free[1][y] = False, False
        single = [np.flatnonzero(f & (not greedy)) for f in free]
        own = np.concatenate([of_left[x], of_left[single[0]], of_right[single[1]]])
        kind = np.repeat([0, 1, 2], [len(x), *map(len, single)])
        padded = lambda v, *rest: np.concatenate([v, *rest, np.zeros(len(kind) - len(v) - sum(map(len, rest)), v.dtype)])
        return pa.RecordBatch.from_arrays([
            b.column(0).take(pa.array(own)), pa.array(padded(at_left[x], at_left[single[0]]), mask=kind == 2), pa.array(padded(at_right[y], np.zeros(len(single[0]), np.int64), at_right[single[1]]), mask=kind == 1),
            pa.array(padded(total), mask=kind > 0), pa.array(padded(bits)), pa.array(padded(agree), mask=kind > 0),
        ], kept.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = P.Ratios()
        for b in batches:
            n = [pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2)]
            pieces = np.cumsum(n[0] * n[1] + n[0] + n[1]) // PAIRS  # a slice of the batch is one group or about so many pairs
            cuts = [0, *(np.flatnonzero(pieces[1:] != pieces[:-1]) + 1).tolist(), len(pieces)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z:
                    yield solved(b.slice(a, z - a), ratios)

    return rows.mapInArrow(run, kept)


def _wrong(name: str, fields: Sequence[str]) -> Column:
    """The wrong fields of a row of ``_assigned``, the name first."""
    rest = F.array_compact(F.array(*(F.when(F.shiftright("bits", n).bitwiseAND(F.lit(1)) == 1, F.lit(c)) for n, c in enumerate(fields)))) if fields else F.array().cast("array<string>")
    return F.when(F.col("gate"), rest).otherwise(F.concat(F.array(F.lit(name)), rest))


def closest(curated: DataFrame, extracted: DataFrame, group: str, index: str, name: str, numbers: Sequence[str], names: Sequence[str] = (), gate: float = P.GATE, tolerance: float = P.TOLERANCE, ratio: bool = True) -> DataFrame:
    """(group, i, j, gate, penalty, cost, wrong): what ``matched`` of ``pairs`` chooses closest first, in one pass over both sides.

    Of a group, a task holds its records and the pairs whose names agree; records that these leave over pair up in order.
    """
    found = _assigned(curated, extracted, group, index, name, numbers, names, gate, tolerance, ratio, greedy=True)
    penalty = F.col("sum") / (1 + len(names) + len(numbers))
    return found.select(group, "i", "j", "gate", penalty.alias("penalty"), F.when(F.col("gate"), penalty).otherwise(GATE_COST).alias("cost"), _wrong(name, (*names, *numbers)).alias("wrong"))


def evaluate(curated: DataFrame, extracted: DataFrame, group: str, index: str, name: str, numbers: Sequence[str], names: Sequence[str] = (), accept: float = P.ACCEPT, documents: DataFrame | None = None, gate: float = P.GATE, tolerance: float = P.TOLERANCE, ratio: bool = True) -> DataFrame:
    """Labels of an extraction, as ``labels`` of ``matched`` ``pairs`` gives them, in one pass over both sides: what the matcher
    leaves over comes out of it too, so neither side is read again."""
    found = _assigned(curated, extracted, group, index, name, numbers, names, gate, tolerance, ratio, documents)
    penalty = F.col("sum") / (1 + len(names) + len(numbers))
    met, good = F.col("i").isNotNull() & F.col("j").isNotNull(), F.col("gate") & (F.col("__penalty") < accept)
    verdict = F.when(F.col("j").isNull(), "FN").when(F.col("i").isNull(), "FP").when(good, "TP").otherwise("MISMATCH")
    reason = F.when(~met, "no counterpart").when(good, F.lit(None)).when(~F.col("gate"), "names differ").otherwise("numbers differ")
    every = F.when(~met, F.array().cast("array<string>")).otherwise(_wrong(name, (*names, *numbers)))
    return found.withColumn("__penalty", penalty).select(group, verdict.alias("verdict"), "i", "j", F.round("__penalty", 4).alias("penalty"), reason.alias("reason"), every.alias("wrong"))


def field_errors(label_table: DataFrame) -> DataFrame:
    """How often each field was wrong in accepted pairs."""
    return label_table.filter("verdict = 'TP'").select(F.explode("wrong").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def sweep(pair_table: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, accepted, mean_penalty): pairs under each threshold, all in one pass; thresholds that accept none are left out."""
    under = lambda t: F.col("gate") & (F.col("penalty") < t)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(under(t)).alias("accepted"), F.avg(F.when(under(t), F.col("penalty"))).alias("mean_penalty")) for t in thresholds]
    return pair_table.agg(F.array(*cells).alias("a")).select(F.inline("a")).filter("accepted > 0")


def within_slack(left: Column, right: Column, slack: float) -> Column:
    """Both known and within a share of the larger; null if either is unknown."""
    return F.abs(left - right) <= slack * F.greatest(F.abs(left), F.abs(right), F.lit(1e-9))


def tolerance_join(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str], slack: float, suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs with equal keys whose fields agree wherever both are known, and at least one is known on both sides.

    Numbers within a share of the larger one are at most one bucket of their logarithms apart.  A row is dealt once for each
    pattern of blanks that the other side has, by the first field that both then hold, so pairs meet once, blanks cost no
    cross product and a hot key is spread over its buckets.  The number of partitions is fixed: few rows make many pairs,
    so partitions joined by size would leave all pairs to a task or two.
    """
    a = left.select(*on, *(F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in on))
    b = right.select(*on, *(F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in on))
    width = -math.log1p(-slack) * (1 + 1e-9) if 0 < slack < 1 else None
    powers = [3**i for i in range(len(fields))]

    def held(suffix: str) -> list[Column]:
        """0: blank, 1: in a bucket, 2: a number without one (infinite, NaN, or any if the slack has no buckets), by field."""
        number = lambda f: F.col(f + suffix).cast("double")
        plain = F.lit(width is None)
        return [F.when(number(f).isNull(), 0).when(plain | F.isnan(number(f)) | (F.abs(number(f)) == math.inf), 2).otherwise(1) for f in fields]

    def bucket(x: Column) -> Column:
        return F.floor(F.log(F.greatest(F.abs(x.cast("double")), F.lit(1e-9))) / F.lit(width or 1.0))

    def dealt(df: DataFrame, other: DataFrame, own: str, others: str, wide: bool) -> DataFrame:
        code = lambda suffix: sum((s * p for s, p in zip(held(suffix), powers)), F.lit(0))
        patterns = other.select(code(others).alias("__other")).distinct()
        df = df.withColumn("__own", code(own)).crossJoin(F.broadcast(patterns))  # at most three patterns a field
        state = lambda c, p: F.floor(F.col(c) / p) % 3
        cells = F.when(F.lit(False), F.array().cast("array<struct<field:int,bucket:bigint>>"))
        for i, (f, p) in enumerate(zip(fields, powers)):
            at = bucket(F.col(f + own))
            near = (at - 1, at, at + 1) if wide else (at,)
            cells = cells.when((state("__own", p) == 1) & (state("__other", p) == 1), F.array(*(F.struct(F.lit(i).alias("field"), x.alias("bucket")) for x in near)))
        both = functools.reduce(lambda x, y: x | y, ((state("__own", p) > 0) & (state("__other", p) > 0) for p in powers))
        cells = cells.when(both, F.array(F.struct(F.lit(-1).alias("field"), F.lit(0).cast("long").alias("bucket"))))
        mine, theirs = ("__b", "__a") if wide else ("__a", "__b")
        df = df.withColumn("__cell", F.explode(cells)).select("*", F.col("__own").alias(mine), F.col("__other").alias(theirs), "__cell.field", "__cell.bucket")
        df = df.withColumnsRenamed({"field": "__field", "bucket": "__bucket"}).drop("__own", "__other", "__cell")
        return df.repartition(PARTS, *on, *_CELL)

    pairs_ = [(F.col(f + suffixes[0]), F.col(f + suffixes[1])) for f in fields]
    shared = sum(((x.isNotNull() & y.isNotNull()).cast("int") for x, y in pairs_), F.lit(0))
    agree = F.lit(True)
    for x, y in pairs_:
        agree = agree & F.coalesce(within_slack(x, y, slack), F.lit(True))
    met = dealt(a, b, *suffixes, False).join(dealt(b, a, *reversed(suffixes), True), [*on, *_CELL])
    return met.filter((shared > 0) & agree).drop(*_CELL)


def verified_join(rows: DataFrame, decisions: DataFrame, on: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Decisions at a position, with ``accepted`` only where the content is still what was decided on (nulls equal)."""
    d = decisions.select(*on, *(F.col(c).alias(f"was_{c}") for c in content), *(c for c in decisions.columns if c not in (*on, *content)))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    found = rows.select(*on, *content, F.lit(True).alias("__found"))
    return d.join(found, list(on), "left").withColumn("accepted", F.coalesce(F.col("__found") & same, F.lit(False))).drop("__found", *content)


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join that fails while running if a key of either side is repeated."""
    for side in ("left", "right"):
        df = left if side == "left" else right
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        df = df.withColumn(f"__n_{side}", F.when(n > 1, F.raise_error(F.lit(f"a key of the {side} side is repeated")).cast("long")).otherwise(n))
        left, right = (df, right) if side == "left" else (left, df)
    # the count is used, so that it is computed
    return left.join(right, list(on), how).filter("coalesce(__n_left, 1) = 1 and coalesce(__n_right, 1) = 1").drop("__n_left", "__n_right")
