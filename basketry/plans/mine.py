"""The mining operator: ``mine(lines, spec) -> MineResult``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import itemset_label
from basketry.operators import patterns as P
from basketry.operators.clean import clean_lines
from basketry.operators.sizing import bounded_broadcast, keep
from basketry.operators.utility import base_entries, own_price, own_sum, uo_list
from basketry.plans.spec import MineSpec


@dataclass
class MineResult:
    """Lazy frames of one mining run (M6).

    ``candidates`` and ``pairs`` are built when first asked for, so the size
    check of the gate runs only for callers that want pairs.
    """

    spec: MineSpec
    uo: DataFrame
    all_singles: DataFrame
    holds: list = field(default_factory=list)

    @cached_property
    def singles(self) -> DataFrame:
        return P.as_text(P.keep_rule(self.all_singles, self.spec.min_util, self.spec.min_uo_single))

    @cached_property
    def candidates(self) -> DataFrame:
        return candidates(self.uo, self.all_singles, self.spec, self.holds)

    @cached_property
    def buckets(self) -> int:
        """Number of buckets of the pair bounds: two a pair row, since buckets of many pairs would all be kept;
        the fixed number for few pairs, and without eager checks."""
        if self.spec.broadcast_max_rows <= 0:
            return P.PAIR_BUCKETS
        rows = self.candidates.agg((F.sum(F.col("n_items") - 1)).alias("n")).first().n or 0  # twice the pairs
        return int(min(P.MARK_BITS, max(P.PAIR_BUCKETS, rows)))

    @cached_property
    def pair_buckets(self) -> DataFrame | None:
        """Buckets of the pairs to measure, under ``prune="bounds"``; held, as a caller may read them too."""
        spec = self.spec
        if spec.prune != "bounds":
            return None
        limits = (spec.min_util, spec.pair_uo, spec.split_items, self.buckets)
        find = P.pair_marks if self.buckets > P.PAIR_BUCKETS else P.pair_buckets
        kept = find(self.candidates, *limits)
        if spec.reuse != "none":
            kept = keep(kept, spec.reuse)
            self.holds.append(kept)
        return kept

    @cached_property
    def pairs(self) -> DataFrame:
        spec = self.spec
        return P.keep_rule(self._measured(spec.pair_uo, self.pair_buckets), spec.min_util, spec.pair_uo)

    def _measured(self, min_uo: float, buckets: DataFrame | None = None) -> DataFrame:
        """Measures of the pairs that can reach ``min_uo``; of all pairs where it asks for nothing."""
        spec = self.spec
        if buckets is not None or not min_uo > 0:
            return P.pairs(self.candidates, spec.split_items, *((buckets, self.buckets) if buckets is not None else ()))
        return P.pairs_reaching(self.candidates, min_uo, spec.split_items, _test_pairs(spec))

    def release(self) -> None:
        """Drop the held UO-list and the held small sides (scope edge of P1)."""
        for df in self.holds:
            df.unpersist()
        self.holds.clear()

    def combined(self) -> DataFrame:
        """K4: size-1 then size-2 results in one frame."""
        return self._combined()

    def _combined(self, *more: str) -> DataFrame:
        one = self.singles.select(
            F.lit(1).alias("size"),
            F.col("item").alias("item1"),
            F.lit(None).cast("string").alias("item2"),
            F.col("item").alias("itemset"),
            "total_util",
            "avg_uo",
            "support",
            *more,
        )
        two = self.pairs.select(
            F.lit(2).alias("size"), "item1", "item2", "itemset", "total_util", "avg_uo", "support", *more
        )
        return one.unionByName(two)


def _test_pairs(spec: MineSpec) -> int | None:
    """Pair rows from which they are tested before the aggregate: only held entries are read again for it."""
    return None if spec.reuse == "none" else P.TEST_PAIRS


def candidates(uo: DataFrame, all_singles: DataFrame, spec: MineSpec, holds: list | None = None) -> DataFrame:
    """Entries allowed into the pair step under ``spec.prune``."""
    if spec.prune == "none":
        return uo
    if spec.prune == "winners":
        kept = P.keep_rule(all_singles, spec.min_util, spec.min_uo_single)
    else:
        kept = P.exact_candidates(uo, spec.min_util, spec.pair_uo)
    side, few = bounded_broadcast(kept.select("item").distinct(), spec.broadcast_max_rows, holds)
    return gated(uo, side, few, spec, holds)


def gated(uo: DataFrame, side: DataFrame, few: bool, spec: MineSpec, holds: list | None) -> DataFrame:
    """Entries of the items of ``side``, distributed by transaction as the UO-list is.

    A broadcast (``few``) leaves them so.  A shuffle by item does not, and the pair step reads the
    entries several times: they are brought back once and held, without ``uo``, which ``iu`` and
    ``tu`` give.
    """
    if few or holds is None or spec.reuse == "none":
        return uo.join(side, "item", "left_semi")
    rows = uo.drop("uo").join(side, "item", "left_semi").repartition("tid")
    holds.append(keep(rows, spec.reuse))
    return holds[-1].withColumn("uo", F.col("iu") / F.col("tu")).select(*uo.columns)


def _held_uo(uo: DataFrame, spec: MineSpec, holds: list) -> DataFrame:
    """The UO-list, held without ``uo``, which ``iu`` and ``tu`` give."""
    if spec.reuse == "none":
        return uo
    holds.append(keep(uo.drop("uo"), spec.reuse))
    return holds[-1].withColumn("uo", F.col("iu") / F.col("tu")).select(*uo.columns)


def _mined(uo: DataFrame, spec: MineSpec, holds: list) -> MineResult:
    uo = _held_uo(uo, spec, holds)
    return MineResult(spec=spec, uo=uo, all_singles=P.singles(uo), holds=holds)


def mine(lines: DataFrame, spec: MineSpec, clean: bool = True) -> MineResult:
    """Mine size-1 and size-2 high-utility-occupancy patterns.

    ``lines`` follows the basket-lines contract (tid, item, quantity,
    unit_price [, tu, seq]).  The UO-list is built once and held (``spec.reuse``)
    because the size-1 step, the gate and the pair step all read it.
    """
    holds: list = []
    return _mined(uo_list(lines, spec, clean=clean, holds=holds), spec, holds)


def mine_together(lines: DataFrame, specs, clean: bool = True) -> list[MineResult]:
    """Several runs on the same lines: the lines are scanned and shuffled once, to entries with
    the sums of every price policy, which all runs read.

    The runs must agree on ``tu``, since lines without a TU count only where none is read.
    The shared entries are held as the first spec's ``reuse`` says; releasing any run frees
    them (another one then computes them again).
    """
    specs = list(specs)
    if len({s.tu for s in specs}) > 1:
        raise ValueError('runs that share their entries need the same "tu"')
    given = bool(specs) and specs[0].tu == "given"
    if given and "tu" not in lines.columns:
        raise ValueError('tu="given" needs a "tu" column')
    if clean:
        lines = clean_lines(lines, given_tu=given)
    results: list = []
    base = keep(base_entries(lines, *specs), specs[0].reuse) if specs else None
    for spec in specs:
        holds = [base] if spec.reuse != "none" else []
        results.append(_mined(uo_list(lines, spec, holds=holds, base=base), spec, holds))
    return results


#: Width of a run's number, set before the keys of its lines in a shared plan.
RUN_DIGITS = 6


def _tag(number: int) -> str:
    return f"{number:0{RUN_DIGITS}d}"


def _policy(lines: DataFrame, spec: MineSpec, number: int) -> tuple:
    """What runs must have in common to share a plan: all but thresholds, pruning and denylists.

    A decimal number stays in its own type; a run pruned by pair bounds is alone, since its
    buckets are chosen by its thresholds.
    """
    price = spec.price if own_price(spec) is None else "actual"
    shared = spec.with_(min_util=0, min_uo_single=0, min_uo_pair=None, price=price, constant_price=1.0, exclude=(), prune="none")
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    numbers = tuple(t if t.startswith("decimal") else "" for t in (types[c] for c in ("quantity", "unit_price")))
    order = types.get("seq") if price == "first_seen" else None
    tu = types.get("tu") if spec.tu == "given" else None
    return (shared, numbers, order, tu, number if spec.prune == "bounds" else None)


def _tagged_lines(lines: DataFrame, spec: MineSpec, number: int) -> DataFrame:
    """Clean lines of a run with its number before both keys; prices that need no
    other row are set here, from the run's own items."""
    given = spec.tu == "given"
    lines, own = clean_lines(lines, given_tu=given), own_price(spec)
    key = {c: F.concat(F.lit(_tag(number)), F.col(c).cast("string")).alias(c) for c in ("tid", "item")}
    extra = [c for c, on in (("tu", given), ("seq", spec.price == "first_seen")) if on and c in lines.columns]
    return lines.select(key["tid"], key["item"], "quantity", (F.col("unit_price") if own is None else own).alias("unit_price"), *extra)


def _reads(spec: MineSpec) -> tuple:
    """What two runs on the same lines must have in common to read the same entries."""
    return spec.price, spec.constant_price if spec.price == "constant" else None, tuple(map(str, spec.exclude))


def _sources(runs) -> list[tuple]:
    """``(number, lines, spec, runs)``: held runs that differ in thresholds and pruning only read the same
    entries, under the number of the first."""
    out: list = []
    for run in runs:
        k, _, lines, spec = run
        same = (s for s in out if spec.reuse != "none" and _reads(spec) == _reads(s[2]) and lines.sameSemantics(s[1]))
        if (source := next(same, None)) is not None:
            source[3].append(run)
        else:
            out.append((k, lines, spec, [run]))
    return out


def _plain_keys(lines: DataFrame) -> bool:
    """Keys that are equal where their texts are, and numbers that are no decimals."""
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    keys = all(types[c] in ("string", "tinyint", "smallint", "int", "bigint") for c in ("tid", "item"))
    return keys and not any(types[c].startswith("decimal") for c in ("quantity", "unit_price"))


def _tagged_entries(sources: list[tuple], spec: MineSpec) -> DataFrame:
    """``base_entries`` of all sources with their numbers before both keys.

    Held sources that differ in prices that need no other row are grouped together, on the keys as they are: one row
    with a sum for each price, which becomes one of each source after the shuffle.
    """
    rest, groups = [], []
    for source in sources:
        _, lines, own, _ = source
        if own.tu == "given" and "tu" not in lines.columns:
            raise ValueError('tu="given" needs a "tu" column')
        if own.reuse == "none" or own_price(own) is None or not _plain_keys(lines):
            rest.append(source)
        elif (group := next((g for g in groups if lines.sameSemantics(g[0][1])), None)) is not None:
            group.append(source)
        else:
            groups.append([source])
    rest += [g[0] for g in groups if len(g) == 1]
    entries = None
    if rest:
        tagged = [_tagged_lines(lines, own, k) for k, lines, own, _ in rest]
        entries = base_entries(reduce(DataFrame.unionByName, tagged), spec)
    for group in (g for g in groups if len(g) > 1):
        lines = clean_lines(group[0][1], given_tu=spec.tu == "given")
        base = base_entries(lines, *(own for _, _, own, _ in group))
        parts = F.array(*(F.struct(F.lit(_tag(k)).alias("_run"), F.col(own_sum(own)).alias("_iu")) for k, _, own, _ in group))
        kept = [c for c in base.columns if c in ("mult", "tu")]
        rows = base.select("tid", "item", *kept, F.inline(parts))
        key = [F.concat("_run", F.col(c).cast("string")).alias(c) for c in ("tid", "item")]
        rows = rows.select(*key, F.col("_iu").alias(own_sum(spec)), *kept)
        entries = rows if entries is None else entries.unionByName(rows)
    return entries


def _limits(lines: DataFrame, sources) -> DataFrame:
    """The thresholds of the runs, one row each; ``run`` is the number of their source, ``number`` their own."""
    rows = [
        F.struct(
            F.lit(_tag(at)).alias("run"), F.lit(k).alias("number"), F.lit(name).alias("dataset"), F.lit(spec.prune).alias("prune"),
            F.lit(float(spec.min_util)).alias("min_util"), F.lit(float(spec.min_uo_single)).alias("min_uo_single"),
            F.lit(float(spec.pair_uo)).alias("min_uo_pair"),
        )
        for at, _, _, runs in sources
        for k, name, _, spec in runs
    ]
    return lines.sparkSession.range(1).select(F.inline(F.array(*rows)))


@dataclass
class SharedResult(MineResult):
    """Runs mined in one plan: keys carry the number of the run, or of the first of those that read the
    same entries; thresholds come from ``limits`` (one row a run) after the aggregates.  Frames have
    the run's name as ``dataset``."""

    limits: DataFrame | None = None
    #: The sources of each kind of pruning, by their numbers as set before the keys; of a source that any run
    #: reads without pruning only this.
    prunes: dict = field(default_factory=dict)
    #: Runs pruned by winners whose source has entries for other runs too.
    among: tuple = ()
    #: The least pair threshold of each source.
    least: dict = field(default_factory=dict)

    def _met(self, df: DataFrame, item: str) -> DataFrame:
        return df.withColumn("run", F.substring(item, 1, RUN_DIGITS)).join(F.broadcast(self.limits), "run")

    def _out(self, df: DataFrame, *items: str) -> DataFrame:
        for c in items:
            df = df.withColumn(c, F.expr(f"substring({c}, {RUN_DIGITS + 1})"))
        return df.drop(*(c for c in self.limits.columns if c != "dataset"))

    @cached_property
    def winners(self) -> DataFrame:
        return P.keep_rule(self._met(self.all_singles, "item"), F.col("min_util"), F.col("min_uo_single"))

    @cached_property
    def singles(self) -> DataFrame:
        return self._out(self.winners, "item")

    def _entries(self, *prunes: str) -> DataFrame:
        """Entries of the runs that are pruned so."""
        if set(self.prunes) <= set(prunes):
            return self.uo
        return self.uo.where(F.substring("tid", 1, RUN_DIGITS).isin([tag for p in prunes for tag in self.prunes.get(p, ())]))

    @cached_property
    def candidate_parts(self) -> list[DataFrame]:
        """Entries allowed into the pair step: of runs without pruning as they lie, gated ones of the others."""
        parts = [self._entries("none")] if "none" in self.prunes else []
        kept = []
        if "winners" in self.prunes:
            gate = (F.col("prune") == "winners") & F.col("run").isin(self.prunes["winners"])
            kept.append(self.winners.where(gate).select("item"))
        if "exact" in self.prunes:
            bounds = self._met(P.exact_bounds(self._entries("exact")), "item").where(F.col("prune") == "exact")
            kept.append(P.within_bounds(bounds, F.col("min_util"), F.col("min_uo_pair")).select("item"))
        if kept:
            items = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
            side, few = bounded_broadcast(items.distinct(), self.spec.broadcast_max_rows, self.holds)
            parts.append(gated(self._entries("winners", "exact"), side, few, self.spec, self.holds))
        return parts

    @cached_property
    def candidates(self) -> DataFrame:
        out = self.candidate_parts[0]
        for part in self.candidate_parts[1:]:
            out = out.unionByName(part)
        return out

    def _measured(self, min_uo: float, buckets: DataFrame | None = None) -> DataFrame:
        # A transaction lies in one part: each part's pairs are made where its entries lie.
        if min_uo > 0:
            own = F.create_map(*(F.lit(x) for tag, uo in self.least.items() for x in (tag, uo)))[F.substring("tid", 1, RUN_DIGITS)]
            return P.pairs_reaching(self.candidate_parts, min_uo, self.spec.split_items, _test_pairs(self.spec), own)
        return P.pairs(self.candidates, self.spec.split_items)

    @cached_property
    def pairs(self) -> DataFrame:
        rows = self._met(self._measured(min(self.least.values())), "item1")
        rows = P.keep_rule(rows, F.col("min_util"), F.col("min_uo_pair"))
        if self.among:
            rows = self._of_winners(rows)
        kept = self._out(rows, "item1", "item2")
        return kept.withColumn("itemset", itemset_label("item1", "item2"))

    def _of_winners(self, rows: DataFrame) -> DataFrame:
        """Kept pairs without those of ``among`` that hold an item which is no winner of their run.  Exactly
        pruned runs need no such test: no pair that is kept falls to their pruning."""
        side = self.winners.where(F.col("number").isin(*self.among)).select("number", "item")
        side, few = bounded_broadcast(side, self.spec.broadcast_max_rows, self.holds)
        for c in ("item1", "item2"):
            won = side.select(F.col("number").alias("_number"), F.col("item").alias("_item"))
            won = F.broadcast(won) if few else won
            rows = rows.join(won, (F.col("number") == F.col("_number")) & (F.col(c) == F.col("_item")), "left")
            rows = rows.where(~F.col("number").isin(*self.among) | F.col("_item").isNotNull()).drop("_number", "_item")
        return rows

    def combined(self) -> DataFrame:
        return self._combined("dataset")


def _shared(runs, spec: MineSpec) -> SharedResult:
    """One plan for ``runs`` of ``(number, name, lines, spec)`` whose policies agree with ``spec``."""
    sources = _sources(runs)
    exclude = tuple(_tag(k) + str(x) for k, _, s, _ in sources for x in s.exclude)
    holds: list = []
    spec = spec.with_(exclude=exclude)
    base = _tagged_entries(sources, spec)
    if own_price(spec) is None:  # read by the prices and by the priced rows
        base = keep(base, spec.reuse)
        holds += [base] if spec.reuse != "none" else []
    uo = _held_uo(uo_list(base, spec, clean=False, holds=holds, base=base), spec, holds)
    limits = _limits(base, sources)
    prunes: dict = {}
    among: list = []
    for k, _, _, own in sources:
        kinds = {s.prune for *_, s in own}
        for kind in {"none"} if "none" in kinds else kinds:
            prunes.setdefault(kind, []).append(_tag(k))
        if len(own) > 1:
            among += [n for n, *_, s in own if s.prune == "winners"]
    singles = P.singles(uo)
    # Read by the result, by the gate and by the test of shared sources' pairs.
    if spec.reuse != "none" and any(s.prune == "winners" for *_, s in runs):
        singles = keep(singles, spec.reuse)
        holds.append(singles)
    return SharedResult(spec, uo, singles, holds, limits, prunes, tuple(among), {_tag(k): min(float(s.pair_uo) for *_, s in own) for k, _, _, own in sources})


def mine_many(runs, results: list | None = None) -> DataFrame:
    """Several (name, lines, spec) runs as one frame with a ``dataset`` column.

    Runs whose policies agree are mined together: their lines are united with the run's number
    in both keys, so there is one set of shuffles however many runs, held runs that differ in thresholds and
    pruning only read the same entries, and each run's thresholds, from a table with one row a run, are applied after the aggregates.
    Thresholds, denylists, pruning (``"none"``, ``"winners"``, ``"exact"``) and prices that need no
    other row may differ; a run with ``prune="bounds"`` or other policies has a plan of its own.

    The results (``MineResult``, one a plan) are appended to ``results``, for the caller to
    release after reading; every source is then scanned once.  Without it nothing is held, and
    every plan reads its input as often as it needs.
    """
    shared: dict = {}
    for k, (name, lines, spec) in enumerate(runs):
        if results is None:
            spec = replace(spec, reuse="none", broadcast_max_rows=0)
        shared.setdefault(_policy(lines, spec, k), []).append((k, name, lines, spec))
    if not shared:
        raise ValueError("mine_many needs at least one run")
    out = None
    for policy, members in shared.items():
        if len(members) == 1:
            _, name, lines, spec = members[0]
            result = mine(lines, spec)
            frame = result.combined().withColumn("dataset", F.lit(name))
        else:
            result = _shared(members, policy[0])
            frame = result.combined()
        if results is not None:
            results.append(result)
        out = frame if out is None else out.unionByName(frame)
    return out
