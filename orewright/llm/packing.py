"""Filling containers of fixed capacities with texts by bin completion.

Texts are dealt by hash into groups of about `GROUP_TOKENS` tokens, so a group fits a task
whatever the size of the corpus and however uneven its sources. In each group the kinds
of container are filled from the smallest to the largest. For one kind the largest text
left is put into an empty container and completed by a set of further ones. All undominated
fillings are enumerated, one at a time as the search asks for them, from small waste to
large; a filling is dominated if a text left out could take the place of some of its texts
(or of none) that are no larger together. A branch ends when the space its containers
leave unused exceeds the bound of the best solution known, which best-fit decreasing
provides at first. The search stops at the lower bound of containers or after `STEPS`
steps a text, enumeration included, and keeps the best found; that is its only limit.

A text goes to the smallest kind that holds it. Texts in containers filled to less than
`GOOD` are handed on to the next larger kind, where they fill gaps; the least filled
containers of all groups are at last filled anew together, in groups of the same size.
Only a text larger than the largest capacity is divided: into full containers and a rest
that is packed like a text.

Defined results for odd input: null texts are not packed, empty ones take 0 tokens and
join any container; double rows of a document count once, equal ids with different texts
are packed each; a container kind without a positive capacity is left out; without kinds
or documents the result is empty.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.llm.tokens import sized
from orewright.session import cores, materialize

#: Tokens of a group, steps of a search for each of its texts, fill from which a container is done.
GROUP_TOKENS, STEPS, GOOD = 1_000_000, 100, 0.995
#: Kinds of container a table may have; more raise an error.
MOST_KINDS = 10_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of indices) by best-fit decreasing."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect.bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        bisect.insort(room, (left - sizes[i], b))
    return bins


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: float = float("inf")):
        self.left = steps


def _bits(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


def dominated(own: list[int], waste: int, others: int) -> bool:
    """Whether a text out of `others` (bits of sizes) can take the place of texts of sizes `own`, or of none,
    that are together no larger and at most `waste` smaller."""
    sums = 1
    for s in own:
        sums |= sums << s
    reach = 0
    while reach < waste:  # sums within `waste` below a size
        shift = min(reach + 1, waste - reach)
        sums |= sums << shift
        reach += shift
    return bool(sums & others & ~1)


def undominated(sizes: list[int], space: int, waste: int, others: int | None = None, budget: Budget | None = None) -> Iterator[list[int]]:
    """Sets of places in `sizes` (falling) that fill `space` to within `waste`, none dominated: those with the least
    waste first, by doubling bounds, and among those the ones with the largest texts first. `others` are the bits
    of the sizes that are left, those of `sizes` if not given."""
    n = len(sizes)
    keys = [-s for s in sizes]
    tail = [0, *accumulate(reversed(sizes))][::-1]
    others = _bits(sizes) if others is None else others
    budget = budget or Budget()
    below, bound = -1, min(waste, space // 1000)
    while True:
        path: list[tuple[int, int, int]] = []  # (place taken, space before it, least size passed over before it)
        left, at, passed = space, bisect.bisect_left(keys, -space), space + 1
        while budget.left > 0:
            budget.left -= 1
            if at < n and left and tail[at] >= left - bound:
                path.append((at, left, passed))
                left -= sizes[at]
                at = bisect.bisect_left(keys, -left, at + 1)
                continue
            if below < left <= bound and passed > left and (at >= n or not left):
                own = [sizes[i] for i, *_ in path]
                if not dominated(own, left, others & ~_bits(own)):
                    yield [i for i, *_ in path]
            if not path:
                break
            i, left, passed = path.pop()  # the next choice is a smaller text, as equal sizes are equal choices
            passed = min(passed, sizes[i])
            at = bisect.bisect_right(keys, keys[i], i + 1)
        if bound >= waste or budget.left <= 0:
            return
        below, bound = bound, min(waste, 2 * bound + 1)


def completions(sizes: list[int], space: int, waste: int, width: int) -> list[list[int]]:
    """The first `width` of the undominated fillings, the fullest of these first."""
    found = islice(undominated(sizes, space, waste), width)
    return sorted(found, key=lambda taken: -sum(sizes[i] for i in taken))


def bin_completion(sizes: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Containers (lists of indices) for texts that each fit the capacity."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = max(-(-total // capacity), sum(2 * s > capacity for s in sizes))
    if len(best) <= least or not sizes:
        return best
    budget = Budget(steps * len(sizes))
    many = Counter(sizes)
    others = _bits(many)
    # each level holds what was left to pack, the fillings of its container still to try, and the space unused before it
    stack: list[tuple[list[int], Iterator[list[int]], int]] = []
    filled: list[list[int]] = []
    left, used = sorted(range(len(sizes)), key=lambda i: -sizes[i]), 0

    def fillings(left: list[int], used: int) -> Iterator[list[int]]:
        allowed = (len(best) - 1) * capacity - total - used  # unused space that still beats the best
        if allowed < 0:
            return
        first, rest = sizes[left[0]], left[1:]
        free = others if many[first] > 1 else others & ~(1 << first)
        for taken in undominated([sizes[i] for i in rest], capacity - first, allowed, free, budget):
            yield [left[0], *(rest[k] for k in taken)]

    options = fillings(left, used)
    while True:
        take = next(options, None)
        if take is not None:
            stack.append((left, options, used))
            filled.append(take)
            gone = set(take)
            used += capacity - sum(sizes[i] for i in take)
            left = [i for i in left if i not in gone]
            for i in take:
                many[sizes[i]] -= 1
                if not many[sizes[i]]:
                    others &= ~(1 << sizes[i])
            if not left:
                if len(filled) < len(best):
                    best = [list(b) for b in filled]
                if len(best) <= least:
                    return best
                options = iter(())
            else:
                options = fillings(left, used)
        elif not stack or budget.left <= 0:
            # the containers filled so far and best fit for the rest may beat the best
            rest = best_fit([sizes[i] for i in left], capacity)
            if len(filled) + len(rest) < len(best):
                best = [*map(list, filled), *[[left[k] for k in b] for b in rest]]
            return best
        else:
            left, options, used = stack.pop()
            for i in filled.pop():
                many[sizes[i]] += 1
                others |= 1 << sizes[i]


def pack_group(sizes: list[int], kinds: list[tuple[str, int]]) -> list[tuple[str, int, list[int]]]:
    """(kind, capacity, indices) of the containers for a group of texts, all fitting the largest kind."""
    out: list[tuple[str, int, list[int]]] = []
    waiting: list[int] = []
    kinds = sorted(kinds, key=lambda k: k[1])
    below = -1
    for level, (name, capacity) in enumerate(kinds):
        mine = waiting + [i for i in range(len(sizes)) if below < sizes[i] <= capacity]
        below, waiting = capacity, []
        own = [sizes[i] for i in mine]
        for b in bin_completion(own, capacity):
            if sum(own[k] for k in b) >= GOOD * capacity:
                out.append((name, capacity, [mine[k] for k in b]))
            else:
                waiting += [mine[k] for k in b]
    # large texts are left without small ones to go with: smaller containers give theirs back
    name, capacity = kinds[-1]
    while waiting:
        bins = bin_completion([sizes[i] for i in waiting], capacity)
        gap = len(bins) * capacity - sum(sizes[i] for i in waiting)
        donors = [k for k, (_, c, m) in enumerate(out) if c < capacity and len(m) > 1 and c * 2 <= gap] if len(bins) > 1 and gap > capacity // 8 else []
        if not donors:
            out += [(name, capacity, [waiting[k] for k in b]) for b in bins]
            break
        take = set()
        for k in donors:
            if gap < out[k][1]:
                break
            gap -= out[k][1]
            take.add(k)
            waiting += out[k][2]
        out = [b for k, b in enumerate(out) if k not in take]
    return out


def _group_packer(kinds: list[tuple[str, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no", "tokens"], na_position="first", ignore_index=True)
        sizes, rows = pdf["tokens"].tolist(), []
        for no, (name, capacity, members) in enumerate(pack_group(sizes, kinds)):
            fill = sum(sizes[i] for i in members)
            rows += [(name, capacity, f"{pdf['grp'].iloc[0]}-{no}", fill, i) for i in members]
        out = pd.DataFrame(rows, columns=["container", "capacity_tokens", "bin_id", "bin_tokens", "i"])
        own = pdf.loc[out["i"], ["doc_id", "piece_no", "start_token", "tokens"]].reset_index(drop=True)
        return pd.concat([out.drop(columns="i"), own], axis=1)

    return run


_PACKED = "container string, capacity_tokens int, bin_id string, bin_tokens bigint, doc_id bigint, piece_no int, start_token int, tokens int"


def _in_groups(items: DataFrame, total: int, salt: int) -> DataFrame:
    """Items with the group they are dealt to; groups are spread over all cores, as they are few bytes and much work."""
    n = max(1, round(total / GROUP_TOKENS))
    spark = items.sparkSession
    parts = min(n, max(3 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = items.withColumn("grp", F.concat(F.lit(f"{salt}-"), F.pmod(F.xxhash64("doc_id", "piece_no", "tokens", F.lit(salt)), F.lit(n))))
    return dealt.repartition(parts, "grp")


def pack(docs: DataFrame, containers: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(container, capacity_tokens, bin_id, bin_tokens, doc_id, piece_no, start_token, tokens): each text of
    `docs` (doc_id, text) in its container. Pieces of a divided text are numbered from 1; whole texts have 0."""
    named = containers.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct()
    kinds = sorted(((r["container"], r["capacity_tokens"]) for r in named.limit(MOST_KINDS + 1).collect()), key=lambda k: (k[1], k[0] or ""))
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    spark = docs.sparkSession
    if not kinds:
        return spark.createDataFrame([], _PACKED)
    top = kinds[-1][1]
    named = docs.select("doc_id", "text")
    size = materialize(sized(named.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], vocabulary), "sizes").distinct()
    pieces = F.when(F.col("tokens") > top, F.sequence(F.lit(1), F.ceil(F.col("tokens") / top).cast("int"))).otherwise(F.array(F.lit(0)))
    items = size.select("doc_id", F.col("tokens").alias("all"), F.explode(pieces).alias("piece_no"))
    start = F.when(F.col("piece_no") > 0, (F.col("piece_no") - 1) * top).otherwise(0).cast("int")
    items = items.withColumn("start_token", start).select("doc_id", "piece_no", "start_token", F.least(F.col("all") - F.col("start_token"), F.lit(top)).cast("int").alias("tokens"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    first = materialize(_in_groups(items, total, 1).groupBy("grp").applyInPandas(_group_packer(kinds), _PACKED), "packed")
    good = F.col("bin_tokens") >= F.lit(GOOD) * F.col("capacity_tokens")
    again = first.where(~good).select("doc_id", "piece_no", "start_token", "tokens")
    rest = again.agg(F.sum("tokens")).first()[0] or 0
    second = _in_groups(again, rest, 2).groupBy("grp").applyInPandas(_group_packer(kinds), _PACKED)
    return first.where(good).unionByName(second)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers of each kind, their tokens and the share of their space left unused."""
    bins = packed.groupBy("container", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return bins.groupBy("container", "capacity_tokens").agg(
        F.count("*").alias("bins"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / F.sum("capacity_tokens"), 6).alias("unused_share"), F.min("t").alias("least_filled")
    )
