"""Array functions on token ids: clip, pad, trim, mask, pack, align."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import BLANK, edit_script, flat, positions, top_p_keep  # noqa: F401 - token functions too
from .scans import bind

IGNORED = -100


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n.cast("int"), F.lit(0)))


def head(a: Column, n: Column | int) -> Column:
    """The first n at most."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def tail(a: Column, n: Column | int) -> Column:
    """The last n at most (all if there are fewer)."""
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.least(F.greatest(n, F.lit(0)), F.size(a))
    return F.slice(a, F.size(a) - keep + 1, keep)


def clip(a: Column, most: int, side: str = "right") -> Column:
    """``right`` cuts the end off, ``left`` the beginning."""
    return head(a, most) if side == "right" else tail(a, most)


def clip_response(a: Column, prompt_len: Column, most: int, side: str = "right") -> Column:
    """The prompt stays whole, the response gets what is left; with nothing left and side ``left`` it stays whole."""
    prompt, response = head(a, prompt_len), F.slice(a, prompt_len + 1, F.greatest(F.size(a) - prompt_len, F.lit(0)))
    room = F.greatest(F.lit(most) - prompt_len, F.lit(0))
    kept = head(response, room) if side == "right" else F.when(room == 0, response).otherwise(tail(response, room))
    return F.concat(prompt, kept)


def with_end(a: Column, end: int) -> Column:
    """The end id appended unless it is there."""
    return F.when(F.coalesce(F.try_element_at(a, F.lit(-1)) == end, F.lit(False)), a).otherwise(F.array_append(a, F.lit(end)))


def pad_to_multiple(a: Column, block: int, value: int) -> Column:
    return F.concat(a, repeat(value, F.pmod(-F.size(a), F.lit(block))))


def pad_to(a: Column, width: Column | int, value: int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(a, repeat(value, width - F.size(a)))


def pad_mask(a: Column, width: Column | int) -> Column:
    """1 for each id, 0 for padding."""
    return pad_to(F.transform(a, lambda _: F.lit(1)), width, 0)


def masked_labels(ids: Column, prompt_len: Column) -> Column:
    """Ids with the prompt ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(IGNORED)).otherwise(x))


def until_end(a: Column, end: int) -> Column:
    """1 up to and with the first end id, then 0."""
    at = F.array_position(a, F.lit(end))
    return F.transform(a, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def trim_generation(ids: Column, prompt_len: Column, pad: int, ends: list[int]) -> Column:
    """Generated ids after the prompt, left padding removed first, cut before the first end id."""
    lead = F.coalesce(F.array_position(F.transform(ids, lambda x: (x != pad).cast("int")), F.lit(1)) - 1, F.lit(0)).cast("int")
    own = F.slice(ids, lead + prompt_len + 1, F.greatest(F.size(ids) - lead - prompt_len, F.lit(0)))
    stop = F.array_position(F.transform(own, lambda x: x.isin(ends).cast("int")), F.lit(1)).cast("int")
    return F.when(stop > 0, head(own, stop - 1)).otherwise(own)


def infill(prompt: Column, filled: Column, mask: int, ends: list[int]) -> Column:
    """What stands where the prompt has the mask, cut before the first end id."""
    at = F.filter(F.zip_with(prompt, filled, lambda p, x: F.struct(p.alias("p"), x.alias("x"))), lambda z: z["p"] == mask)
    own = F.transform(at, lambda z: z["x"])
    stop = F.array_position(F.transform(own, lambda x: x.isin(ends).cast("int")), F.lit(1)).cast("int")
    return F.when(stop > 0, head(own, stop - 1)).otherwise(own)


def sees(q: Column, k: Column, n: Column, block: int) -> Column:
    """Whether place q may see place k, of ``n`` noisy places and ``n`` clean ones after them in blocks.

    A noisy block sees itself and the clean blocks before it; a clean one the clean blocks up to itself.
    """
    of = lambda x: F.floor(F.pmod(x, n) / block)
    noisy = lambda x: x < n
    return ((of(q) == of(k)) & (noisy(q) == noisy(k))) | ((of(q) > of(k)) & noisy(q) & ~noisy(k)) | ((of(q) >= of(k)) & ~noisy(q) & ~noisy(k))


def block_mask(n: Column, block: int) -> Column:
    """:func:`sees` for all places of a row, as an array of arrays."""
    places = F.sequence(F.lit(0), 2 * n - 1)
    return F.when(n > 0, F.transform(places, lambda q: F.transform(places, lambda k: sees(q, k, n, block)))).otherwise(F.array().cast("array<array<boolean>>"))


def sampling_mask(valid: Column, block: int) -> Column:
    """Which places see which while blocks are filled one after the other: valid ones those of the blocks up to their own; others neither see nor are seen.

    The valid places of a block see the same, so a mask is made for each block, of slices, and its places share it.
    """

    def made(ok: Column) -> Column:
        rest = lambda n: F.array_repeat(F.lit(False), F.size(ok) - n)
        upto = F.transform(F.filter(F.transform(ok, lambda _, i: i), lambda i: i % block == 0), lambda i: F.concat(F.slice(ok, 1, i + block), rest(F.least(i + block, F.size(ok)))))
        return bind(upto, lambda masks: bind(rest(F.lit(0)), lambda none: F.transform(ok, lambda x, q: F.when(x, F.get(masks, F.floor(q / block).cast("int"))).otherwise(none))))

    return bind(F.transform(valid, lambda x: F.coalesce(x == 1, F.lit(False))), made)


def top_places(scores: Column, k: int) -> Column:
    """Places of the k highest scores, highest first, ties to the earlier."""
    placed = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(head(F.array_sort(placed), k), lambda z: z["i"])


def top_k_keep(logits: Column, k: int) -> Column:
    """Per place, whether its score is among the k highest; ties with the k-th stay."""
    return bind(F.sort_array(logits, asc=False), lambda s: F.transform(logits, lambda x: x >= F.get(s, F.least(F.lit(k), F.size(s)) - 1)))


def choice(logits: Column) -> Column:
    """(place, probability, margin, negentropy) of the likeliest place."""
    def probabilities(top: Column) -> Column:
        weights = F.transform(logits, lambda x: F.exp(x - top))
        return bind(weights, lambda w: bind(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(w, lambda x: x / total)))

    def described(probs: Column) -> Column:
        ordered = F.sort_array(probs, asc=False)
        negentropy = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x * F.log(x + 1e-10))
        return F.struct((F.array_position(logits, F.array_max(logits)) - 1).cast("int").alias("place"), F.get(ordered, F.lit(0)).alias("probability"), (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))).alias("margin"), negentropy.alias("negentropy"))

    return bind(bind(F.array_max(logits), probabilities), described)


def commit_over(confidence: Column, threshold: float) -> Column:
    """Places above the threshold; the best one if there are none."""
    over = F.filter(F.transform(confidence, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())
    return F.when(F.size(over) > 0, over).otherwise(top_places(confidence, 1))


def commit_dynamic(confidence: Column, factor: float) -> Column:
    """Places in order of confidence while each is at least ``1 - factor / (rank + 1)``; the first always."""
    ordered = F.array_sort(F.transform(confidence, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))

    def kept(places: Column) -> Column:
        stops = F.filter(F.transform(places, lambda z, r: F.when((r > 0) & (-z["s"] < 1 - F.lit(factor) / (r + 2)), r)), lambda r: r.isNotNull())
        return F.transform(head(places, F.coalesce(F.array_min(stops), F.size(places))), lambda z: z["i"])

    return bind(ordered, kept)


def commit_or_edit(placed: Column, proposed: Column, confidence: Column, mask: int, threshold: float, edit_threshold: float, k: int) -> Column:
    """The row after one step: masked places take their proposal where the confidence is above the threshold, or at the k most confident if fewer are; placed ones change where the proposal differs and its confidence is above the other threshold."""
    rows = F.arrays_zip(placed.alias("p"), proposed.alias("x"), confidence.alias("c"))

    def stepped(z: Column) -> Column:
        open_ = F.transform(z, lambda r: F.when(r["p"] == mask, r["c"]))
        over = F.size(F.filter(open_, lambda c: c > threshold))
        ordered = F.array_sort(F.filter(F.transform(open_, lambda c, i: F.when(c.isNotNull(), F.struct((-c).alias("s"), i.alias("i")))), lambda q: q.isNotNull()))
        best = F.transform(head(ordered, k), lambda q: q["i"])
        return bind(over, lambda n: bind(best, lambda b: F.transform(z, lambda r, i: F.when(r["p"] == mask, F.when(F.when(n >= k, r["c"] > threshold).otherwise(F.array_contains(b, i)), r["x"]).otherwise(r["p"])).otherwise(F.when((r["x"] != r["p"]) & (r["c"] > edit_threshold), r["x"]).otherwise(r["p"])))))

    return bind(rows, stepped)


def strip_blanks(a: Column) -> Column:
    return F.filter(a, lambda x: x != BLANK)


def blend(source: Column, target: Column, kappa: Column, key: Column) -> Column:
    """Each place from the target with probability kappa, by a hash of the key and the place."""
    pairs = F.zip_with(source, target, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda z, i: F.when(uniform(key, i) < kappa, z["b"]).otherwise(z["a"]))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def forward_mask(ids: Column, labels: Column, p: Column, key: Column, mask: int) -> Column:
    """Ids with each labelled place masked with probability p, by a hash."""
    pairs = F.zip_with(ids, labels, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda z, i: F.when((z["b"] != IGNORED) & (uniform(key, i) < p), F.lit(mask)).otherwise(z["a"]))


def distance_weights(masked: Column, p: float) -> Column:
    """For each masked place, the mean over unmasked ones of a geometric law in the distance; 0 for unmasked places."""
    known = F.filter(F.transform(masked, lambda m, i: F.when(m == 0, i)), lambda i: i.isNotNull())
    law = lambda d: F.lit(p) * F.pow(F.lit(1 - p), d - 1)
    return F.transform(masked, lambda m, i: F.when(m == 1, F.aggregate(known, F.lit(0.0), lambda a, j: a + law(F.abs(i - j))) * 0.5).otherwise(0.0))


def with_start(a: Column, start: int) -> Column:
    """The start id before the others, always."""
    return F.array_prepend(a, F.lit(start))


def ensure_start(a: Column, start: int) -> Column:
    """The start id before the others unless it is there."""
    return F.when(F.coalesce(F.get(a, F.lit(0)) == start, F.lit(False)), a).otherwise(F.array_prepend(a, F.lit(start)))


def cut_suffix(a: Column, keep: Column, value: int) -> Column:
    """The same length with everything from ``keep`` on replaced: a mask's 0, or the ignored label."""
    return F.transform(a, lambda x, i: F.when(i < keep, x).otherwise(F.lit(value)))


def random_length(a: Column, ratio: float, key: Column) -> Column:
    """With the given probability a length from 1 to the array's, else the array's own; by a hash of the key."""
    size = F.size(a)
    drawn = 1 + F.floor(uniform(key, F.lit("length")) * size).cast("int")
    return F.when((uniform(key, F.lit("cut")) < ratio) & (size > 0), F.least(drawn, size)).otherwise(size)


def crop_response(a: Column, prompt_len: Column, kept: Column) -> Column:
    """At most ``kept`` ids after the prompt."""
    return head(a, prompt_len + F.least(F.greatest(F.size(a) - prompt_len, F.lit(0)), kept))


def start_state(ids: Column, prompt_len: Column | None, start: int, fill: Column) -> Column:
    """What an edit flow begins with: the prompt, or the start id alone, then the sampler's ids."""
    return F.concat(head(ensure_start(ids, start), 1), fill) if prompt_len is None else F.concat(head(ids, prompt_len), fill)


def empty_fill() -> Column:
    return F.array().cast("array<int>")


def mask_fill(mask: int, length: int = 128) -> Column:
    return F.array_repeat(F.lit(mask), length)


def gumbel_choice(logits: Column, temperature: float, key: Column) -> Column:
    """The place with the largest ``exp(logit) / (-log u) ** temperature``, u being a hash of key and place; the plain maximum at 0."""
    if temperature == 0:
        return top_places(logits, 1)
    return top_places(F.transform(logits, lambda x, i: x - F.lit(temperature) * F.log(-F.log(F.greatest(uniform(key, i), F.lit(1e-12))))), 1)


def tau_leap(ids: Column, delete: Column, substitute: Column, insert: Column, substituted: Column, inserted: Column, tau: float, prompt_len: Column, key: Column, edit_prompt: bool = False) -> Column:
    """One leap: each place is deleted, substituted or kept, and may get an insertion after it, with rates times ``tau`` as probabilities.

    Places of the prompt (one at least) are only edited on request; insertions may follow its last place. Draws are hashes of
    key and place. The substituted and inserted ids are what a model would have drawn.
    """
    own = F.greatest(F.lit(1), F.least(prompt_len, F.size(ids)))
    rows = F.arrays_zip(ids.alias("x"), delete.alias("d"), substitute.alias("s"), insert.alias("n"), substituted.alias("sx"), inserted.alias("nx"))

    def moved(r: Column, i: Column) -> Column:
        held = F.lit(False) if edit_prompt else i < own
        held_insert = F.lit(False) if edit_prompt else i < own - 1
        rate = F.when(held, 0.0).otherwise(r["d"] + r["s"])
        fires = uniform(key, i, F.lit("edit")) < F.least(rate * tau, F.lit(1 - 1e-6))
        goes = fires & (uniform(key, i, F.lit("kind")) < F.least(r["d"] / (r["d"] + r["s"] + 1e-8), F.lit(1.0)))
        grows = ~held_insert & (uniform(key, i, F.lit("insert")) < F.least(r["n"] * tau, F.lit(1 - 1e-6)))
        here = F.when(goes, F.lit(None).cast("int")).when(fires, r["sx"].cast("int")).otherwise(r["x"].cast("int"))
        return F.array_compact(F.array(here, F.when(grows, r["nx"].cast("int"))))

    return F.flatten(F.transform(rows, moved))


def align(a, b, few: int | None = None, parts: int = 8) -> tuple[list[int], list[int]]:
    """Global alignment with unit costs and blanks; of equal ones diagonal before up before left.

    A row of the table of costs is held as bits, one for each column: where it rises and where it falls from column to
    column, where it equals the row above a column before, and where it is one more than the row above. A step from row to
    row is a dozen operations on whole numbers of as many bits. Only a few rows are kept: a stretch of more than ``few`` is cut
    into ``parts`` at rows that are kept, and walked back from its last part to its first, each cut again. So memory is
    a few MB however long the sequences are, and time a few times that of the rows.
    """
    a, b = list(a), list(b)
    few = few or max(64, (4 << 23) // (len(b) + 1))
    one: list[int] = []
    two: list[int] = []
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j

    def below(rises: int, falls: int, i: int, mask: int) -> tuple[int, int, int, int]:
        """Of the row after the first ``i`` elements': where it rises and falls, where it equals its diagonal neighbour, where it is one more than the row above."""
        equal = places.get(a[i], 0) & mask
        same = ((((equal & rises) + rises) ^ rises) | equal | falls) & mask
        more, less = falls | ((same | rises) ^ mask), same & rises
        up, down = (more << 1 | 1) & mask, less << 1 & mask
        return down | ((same | up) ^ mask), up & same, same, more

    def walk(first: int, last: int, rises: int, falls: int, j: int) -> int:
        """Walk back from row ``last`` and column ``j`` to row ``first``, whose bits are given; the column there."""
        mask = (1 << j) - 1
        rises, falls = rises & mask, falls & mask
        if last - first > few:
            cuts = sorted({first + (last - first) * k // parts for k in range(parts)})
            kept = {first: (rises, falls)}
            for i in range(first, cuts[-1]):
                rises, falls, _, _ = below(rises, falls, i, mask)
                if i + 1 in cuts:
                    kept[i + 1] = rises, falls
            for start, stop in zip(reversed(cuts), reversed([*cuts[1:], last]), strict=True):
                j = walk(start, stop, *kept.pop(start), j)
            return j
        rows = []
        for i in range(first, last):
            rises, falls, same, more = below(rises, falls, i, mask)
            rows.append((same, more))
        i = last
        while i > first:
            x = a[i - 1]
            if not j:
                i -= 1
                one.append(x)
                two.append(BLANK)
                continue
            y = b[j - 1]
            same, more = rows[i - first - 1]
            if x == y or not same >> (j - 1) & 1:
                i, j = i - 1, j - 1
                one.append(x)
                two.append(y)
            elif more >> (j - 1) & 1:
                i -= 1
                one.append(x)
                two.append(BLANK)
            else:
                j -= 1
                one.append(BLANK)
                two.append(y)
        return j

    j = walk(0, len(a), (1 << len(b)) - 1, 0, len(b))
    one += [BLANK] * j
    two += b[:j][::-1]
    return one[::-1], two[::-1]


def align_udf():
    """:func:`align` over Arrow batches; null if a side is null."""

    @F.arrow_udf("struct<source:array<int>,target:array<int>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        (x, at), (y, to) = flat(a), flat(b)
        x, y, both = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), pc.and_(a.is_valid(), b.is_valid())
        made: tuple[list, list] = ([np.empty(0, np.int32)], [np.empty(0, np.int32)])
        ends = np.zeros(len(a) + 1, np.int64)
        for k, ok in enumerate(both.to_pylist()):
            if ok:
                for out, side in zip(made, align(x[at[k] : at[k + 1]].tolist(), y[to[k] : to[k + 1]].tolist()), strict=True):
                    out.append(np.array(side, np.int32))
                ends[k + 1] = len(made[0][-1])
        ends = np.cumsum(ends)
        sides = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out))) for out in made]
        return pa.StructArray.from_arrays(sides, ["source", "target"], mask=pc.invert(both))

    return run
