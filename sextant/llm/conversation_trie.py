"""Trie of conversation prefixes from composable fingerprints.

A conversation's fingerprint is a pair of polynomials in its turns' hashes, modulo 2 ** 61 - 1.  Fingerprints of sequences compose: that of x
followed by y is F(x) * B ** len(y) + F(y), and as B has an inverse a known beginning or end can be taken off again.  So a rebuilt conversation
(head of a base, then the own turns beyond) has the fingerprint of each of its beginnings without being put together, and so has
the beginning one turn shorter.

1. Turns move once with their text, in even ranges of (conversation, turn, role, text).  Running states (count, fingerprint, characters) are taken inside each
   range; what goes on from one range to the next is composed from one state a range, so that a conversation may span many tasks.
2. Each rebuilt conversation gives a row of fixed size for each of its beginnings; equal (depth, fingerprint) are a node.
3. Nodes are verified: all members must refer to one stored turn and to one parent node, and a stored turn must have one role and text.  By induction over depth the
   beginnings are then equal.  Should a fingerprint collide, all is worked out anew with other hashes.
4. Sums over subtrees need no levels.  With the smallest member as a node's lead, a conversation leads its nodes from some depth on, so that it adds to the
   saved characters of a node what it holds from there up to that depth; a leaf counts with its lead.
5. Digests of long lists of ids are fed from texts of bounded size, put together in even ranges.

Edge cases: a null role or text is empty; turns that tie are in the order of role and text; repeated rows are turns of their own; a row with a null
conversation belongs to none; a conversation whose rebuilt form has no turn ends at the root; an empty table has no node; other columns
are ignored; very long texts count in full.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
#: Most turns that a conversation takes over, and one more.
HEADS = 6
#: Conversations of one base.
SPAN = 100
#: Characters of a text of ids.
CHUNK = 1 << 16


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME."""
    half, low32, low29 = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
    a1, a0, b1, b0 = a >> half, a & low32, b >> half, b & low32
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    return reduced((a1 * b1 << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & low29) << half) + (low >> np.uint64(61)) + (low & _P))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + (_P - b))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i for i < n."""
    found = np.ones(1, np.uint64)
    while len(found) < n:
        found = np.concatenate((found, times(found, np.uint64(pow(base, len(found), PRIME)))))
    return found[:n]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    found, step = np.ones(len(exponents), np.uint64), base
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        found = np.where((exponents >> bit) & 1 == 1, times(found, np.uint64(step)), found)
        step = step * step % PRIME
    return found


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME."""
    low = np.uint64((1 << 30) - 1)
    return reduced(times(reduced(np.cumsum(x >> np.uint64(30))), np.uint64(1 << 30)) + reduced(np.cumsum(x & low)))


def bases(salt: int) -> tuple[int, int]:
    r = random.Random(salt)
    return r.randrange(1 << 32, PRIME), r.randrange(1 << 32, PRIME)


def values(key: pa.Array) -> np.ndarray:
    """A turn's hash as a value modulo PRIME."""
    return reduced(key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


STATES = "part int, conv_id long, pos long, k1 long, k2 long, n long, v1 long, v2 long, chars long"


def _scan(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv_id, k1, k2, n) with the state of their conversation after each, as far as this part holds it."""
    held: tuple[int, int, list[int], int] | None = None
    own_bases = bases(salt)
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        conv, n = batch.column("conv_id").to_numpy(), batch.column("n").to_numpy()
        new = np.concatenate(([True], conv[1:] != conv[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        goes_on = (start == 0) & (held is not None and held[0] == conv[0])
        pos, all_chars = np.arange(m) - start, np.cumsum(n)
        chars = all_chars - (all_chars - n)[start]
        if held:
            pos, chars = pos + np.where(goes_on, held[1], 0), chars + np.where(goes_on, held[3], 0)
        states = []
        for k, base in enumerate(own_bases):
            up, down = powers(base, m + 1), powers(pow(base, -1, PRIME), m)
            total = np.concatenate((np.zeros(1, np.uint64), sums(times(values(batch.column(f"k{k + 1}")), down))))
            v = times(up[:m], minus(total[1:], total[start]))
            if held:
                v = np.where(goes_on, reduced(v + times(np.uint64(held[2][k]), up[1:])), v)
            states.append(v)
        held = int(conv[-1]), int(pos[-1]) + 1, [int(v[-1]) for v in states], int(chars[-1])
        names = ["part", "conv_id", "k1", "k2", "n"]
        columns = dict(zip(names, (batch.column(c) for c in names), strict=True)) | {"pos": pa.array(pos), "v1": pa.array(states[0].view(np.int64)), "v2": pa.array(states[1].view(np.int64)), "chars": pa.array(chars)}
        order = [x.split()[0] for x in STATES.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)


Carry = dict[int, tuple[int, int, int, int, int]]


def _carried(batches: Iterator[pa.RecordBatch], carry: Carry, salt: int) -> Iterator[pa.RecordBatch]:
    """States with what earlier parts hold of the conversation put in front."""
    own_bases = bases(salt)
    for batch in batches:
        part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
        columns = {c: batch.column(c).to_numpy() for c in ("pos", "v1", "v2", "chars")}
        for p in np.unique(part).tolist():
            if p in carry:
                of, before, *fronts, chars = carry[p]
                own = (part == p) & (conv == of)
                up = columns["pos"][own] + 1
                columns = {c: v.copy() for c, v in columns.items()}
                for c, base, front in zip(("v1", "v2"), own_bases, fronts, strict=True):
                    v = columns[c][own].view(np.uint64)
                    columns[c][own] = reduced(v + times(power(base, up), np.uint64(front))).view(np.int64)
                columns["pos"][own] += before
                columns["chars"][own] += chars
        yield pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else batch.column(c) for c in batch.schema.names], batch.schema.names)


def carry_over(states: DataFrame, salt: int) -> Carry:
    """What each part's first conversation has in earlier parts.  The driver sees one row a part."""
    state = F.struct(F.expr("pos + 1").alias("n"), "v1", "v2", "chars")
    ends = states.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by(state, F.struct("conv_id", "pos")).alias("x"))
    found: Carry = {}
    held = None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        own = (r["last"], *r["x"])
        if held and held[0] == r["first"]:
            found[r["part"]] = held
            if r["first"] == r["last"]:
                v = [(y + x * pow(b, own[1], PRIME)) % PRIME for x, y, b in zip(held[2:4], own[2:4], bases(salt), strict=True)]
                own = (own[0], held[1] + own[1], *v, held[4] + own[4])
        held = own
    return found


def _composed(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    """Rows (…, k1, k2, v1, v2, w1, w2, e) to fingerprints v + w * B ** e, and to the parents', a turn shorter."""
    own_bases = bases(salt)
    for batch in batches:
        e = batch.column("e").to_numpy()
        made = {}
        for k, base in enumerate(own_bases, 1):
            v, w = (batch.column(f"{c}{k}").to_numpy().view(np.uint64) for c in "vw")
            own = reduced(v + times(w, power(base, e)))
            made[f"f{k}"] = pa.array(own.view(np.int64))
            made[f"p{k}"] = pa.array(times(minus(own, values(batch.column(f"k{k}"))), np.uint64(pow(base, -1, PRIME))).view(np.int64))
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in ROW_NAMES], ROW_NAMES)


ROWS = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, k1 long, k2 long, n long, before long, ends boolean"
ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]
NODE = ["depth", "f1", "f2"]


def turn_key(k: int, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.lit(k), *(("role", "text") if k == 1 else ("text", "role")))


def turn_states(conversations: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(state after each turn of each conversation, stored turns by their key)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"), F.monotonically_increasing_id().alias("row_no"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row_no"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", turn_key(1, salt).alias("k1"), turn_key(2, salt).alias("k2"), F.length("text").cast("long").alias("n"))
    states = materialise(keyed.mapInArrow(lambda it: _scan(it, salt), STATES), "turn-states")
    carry = carry_over(states, salt)
    either = lambda c: (F.min(c).alias(c), F.max(c).alias(f"{c}_"))
    stored = turns.groupBy(turn_key(1, salt).alias("k1"), turn_key(2, salt).alias("k2")).agg(*either("role"), *either("text"))
    return states.mapInArrow(lambda it: _carried(it, carry, salt), STATES), materialise(stored, "stored-turns")


def rebuilt_beginnings(states: DataFrame, salt: int) -> DataFrame:
    """A row for each beginning of each rebuilt conversation, the empty one included: ``ROWS``."""
    head = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "k1", "k2", "n", "v1", "v2", "chars"))
    convs = materialise(states.groupBy("conv_id").agg(F.max("pos").alias("last"), F.array_sort(F.collect_list(head)).alias("heads")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    theirs = convs.select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base_heads"))
    joined = convs.withColumn("h", h).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % SPAN).join(theirs, "base_id", "left")
    joined = joined.withColumn("taken", F.when((F.col("h") > 0) & F.col("base_heads").isNotNull(), F.expr("slice(base_heads, 1, h)")).otherwise(F.expr("slice(heads, 1, 0)")))
    end, own = F.try_element_at("taken", F.lit(-1)), F.expr("case when h > 0 then get(heads, h - 1) end")
    held = lambda x, c: F.coalesce(x[c], F.lit(0).cast("long"))
    # what stands in front of the own turns, less what they have in front themselves
    ahead = [F.pmod(held(end, c) - held(own, c), F.lit(PRIME)).alias(w) for c, w in (("v1", "w1"), ("v2", "w2"))]
    size = F.size("taken").cast("long")
    joint = materialise(joined.select("conv_id", F.col("h").cast("long").alias("h"), "taken", size.alias("n_taken"), *ahead, (held(end, "chars") - held(own, "chars")).alias("w_chars"), (size + F.greatest(F.lit(0).cast("long"), F.expr("last + 1 - h"))).alias("n_turns")), "joints")
    zero = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    root = joint.select("conv_id", *zero("depth", "k1", "k2", "n", "v1", "v2", "w1", "w2", "e", "before"), (F.col("n_turns") == 0).alias("ends"))
    x = F.col("x")
    front = joint.select("conv_id", "n_turns", F.explode("taken").alias("x")).select("conv_id", (x["pos"] + 1).alias("depth"), *(x[c].alias(c) for c in ("k1", "k2", "n", "v1", "v2")), *zero("w1", "w2", "e"), (x["chars"] - x["n"]).alias("before"), (x["pos"] + 1 == F.col("n_turns")).alias("ends"))
    past = states.join(joint.drop("taken"), "conv_id").where("pos >= h").withColumn("e", F.expr("pos - h + 1")).withColumn("depth", F.expr("n_taken + e"))
    back = past.select("conv_id", "depth", "k1", "k2", "n", "v1", "v2", "w1", "w2", "e", F.expr("chars - n + w_chars").alias("before"), F.expr("depth = n_turns").alias("ends"))
    return materialise(root.unionByName(front).unionByName(back).mapInArrow(lambda it: _composed(it, salt), ROWS), "beginnings")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (node, conv_id) to texts of comma-joined ids."""
    names = [*NODE, "first", "ids"]
    own: tuple | None = None
    ids: list[int] = []

    def text() -> tuple:
        return (*own, ids[0], ",".join(map(str, ids)))

    for batch in batches:
        out = []
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if tuple(node) != own or 20 * len(ids) >= CHUNK:
                if ids:
                    out.append(text())
                own, ids = tuple(node), []
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string() if c == "ids" else pa.int64()) for c in names], names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in text()], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the order of (node, first id) to the digest of each node's list."""
    names = [*NODE, "ends_sha256"]
    own, digest = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if tuple(node) != own:
                if own:
                    out.append((*own, digest.hexdigest()))
                own, digest = tuple(node), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string() if c == "ends_sha256" else pa.int64()) for c in names], names)
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*own, digest.hexdigest())], names)


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = "depth long, f1 long, f2 long"
    ends = rows.where("ends").select(*NODE, "conv_id")
    texts = ends.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_listed, f"{key}, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digested, f"{key}, ends_sha256 string")


def verified_nodes(rows: DataFrame) -> DataFrame:
    """Nodes with their least member; ``sound`` where all members agree on the parent and the stored turn."""
    same = F.lit(True)
    for c in ("p1", "p2", "k1", "k2", "before"):
        same = same & (F.min(c) == F.max(c))
    firsts = [F.min(c).alias(c) for c in ("p1", "p2", "k1", "k2", "n", "before")]
    return materialise(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), *firsts, same.alias("sound")), "nodes")


def conversation_trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` to (nodes, stored turns).

    A node has conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and the key (k1, k2) of its last turn, which names a
    row (k1, k2, role, text) of the stored turns; the root's names none.
    """
    for salt in count(1):
        states, stored = turn_states(conversations, salt)
        rows = rebuilt_beginnings(states, salt)
        nodes = verified_nodes(rows)
        if stored.where("role != role_ or text != text_").isEmpty() and nodes.where("not sound").isEmpty():
            break
    leads = nodes.groupBy("conv_id").agg(F.min("before").alias("led_from"), F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaf"))
    ends = rows.where("ends").select("conv_id", F.expr("before + n").alias("chars"))
    shares = ends.join(leads, "conv_id", "left").select("conv_id", F.coalesce("led_from", "chars").alias("repeated"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    gathered = rows.select(*NODE, "conv_id", "before").join(shares, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.expr("repeated - before"), F.lit(0).cast("long"))).alias("saved_tokens"))
    below = nodes.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.expr("depth + 1").alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(gathered, NODE).join(below, NODE, "left").join(end_digests(rows), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    no_ends = hashlib.sha256(b"").hexdigest()
    found = whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(no_ends)).alias("ends_sha256"), "k1", "k2")
    return found, stored.select("k1", "k2", "role", "text")


OP11_SQL = """
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as turn
  from conversations where conv_id is not null),
bits as (
  select c, max(pos) as n, list_transform(range(8 * length(cast(c as varchar))), lambda i: case when i % 8 = 0 then ascii(substr(cast(c as varchar), i // 8 + 1, 1)) else 0 end) as b
  from turns group by c),
heads as (
  select c, n, c - c % 100 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)),
    lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295) % 6 as h
  from bits),
rebuilt as (
  select s.c, t.pos as d, t.turn from heads s join turns t on t.c = s.base and t.pos <= s.h
  union all
  select s.c, t.pos - s.h + least(s.h, coalesce(b.n, 0)), t.turn from heads s join turns t on t.c = s.c and t.pos > s.h left join heads b on b.c = s.base),
whole as (select s.c, coalesce(list(r.turn order by r.d) filter (r.d is not null), []) as s from heads s left join rebuilt r on r.c = s.c group by s.c),
members as (select c, len(s) as n, unnest(range(len(s) + 1)) as d, s from whole),
nodes as (
  select d, s[:d] as p, min(c) as c, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '') as ended
  from members group by 1, 2),
parents as (select d - 1 as d, p[:d - 1] as p, count(*) as n_children from nodes where d > 0 group by 1, 2),
own as (
  select n.*, coalesce(k.n_children, 0) as n_children, case when n.d = 0 then 0 else (n.n_convs - 1) * length(n.p[n.d].text) end as saved
  from nodes n left join parents k on k.d = n.d and k.p = n.p),
above as (select a.d, u.p[:a.d] as p, u.saved, u.n_children from own u, lateral (select unnest(range(u.d + 1)) as d) a),
subtrees as (select d, p, sum(saved) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from above group by 1, 2)
select o.c as conv_id, o.d as depth, u.c as parent_conv_id, o.n_convs, o.n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, sha256(o.ended) as ends_sha256
from own o join subtrees s on s.d = o.d and s.p = o.p left join nodes u on u.d = o.d - 1 and u.p = o.p[:o.d - 1]
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt ``conversations``."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))[0].drop("k1", "k2")
