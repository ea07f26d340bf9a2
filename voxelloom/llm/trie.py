"""The prefix trie of conversations that are rebuilt from a family's base: families first, then only their nodes.

A turn travels as a digest and a word count, never as text.  One grouping by base id
puts a family (``FAMILY`` conversations and their base) into one task, which rebuilds
its conversations and combines their common prefixes.  What families have in common is
merged by the nodes' keys.

A node's smallest member owns it, and each conversation owns an end of its own path.  So
whatever is summed over a subtree is a sum over the node's members: a child has one
owner, a leaf is the end of its owner, and the words of distinct nodes are those of the
depths that members own.  Families learn the owners of their nodes and sum their own
members; no pass goes over the trie level by level, however deep it is.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import join_groups
from voxelloom.llm.textcore import crc32_sql
from voxelloom.plans.saving import saved

FAMILY, MOST_SHARED = 20, 4
#: Families whose members' ids are put together before they meet the other families': some 2000 ids.
NEAR = 100
ROOT = bytes(16)
_NODE = "base long, node_key binary, parent_key binary, depth int, words long, owner long, n_convs long, n_ends long, ends string, members binary"
_NODE_ARROW = pa.schema([("base", pa.int64()), ("node_key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int32()), ("words", pa.int64()), ("owner", pa.int64()), ("n_convs", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.string()), ("members", pa.binary())])
_SUMS = "node_key binary, parent_owner long, n_children long, n_leaves long, saved_tokens long"
_SUMS_ARROW = pa.schema([("node_key", pa.binary()), ("parent_owner", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def shared_turns(conv: int) -> int:
    """How many first turns a conversation has from its base."""
    return zlib.crc32(str(conv).encode()) % MOST_SHARED


def turns_of(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, words): one row a turn, without its text; rows without conv_id are of no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.filter(conv.isNotNull()).select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(digest, 1, 16).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _rebuilt(table: pa.Table) -> tuple[int, dict[int, tuple[list[bytes], list[int]]]]:
    """The base and each conversation's turns: digests and words, in order."""
    table = table.sort_by([("conv_id", "ascending"), ("digest", "ascending")])
    conv = table.column("conv_id").to_numpy()
    turn = table.column("turn")
    # Null first; the sort is stable, so turns of one number are by digest.
    order = np.lexsort((turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(), conv))
    digest, words = table.column("digest").take(order).to_pylist(), table.column("words").take(order).to_pylist()
    conv = conv[order]
    begin = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])).tolist()
    base = table.column("base")[0].as_py()
    own = {int(conv[a]): (digest[a:b], words[a:b]) for a, b in zip(begin, [*begin[1:], len(conv)], strict=True)}
    first = own.get(base, ([], []))
    out = {}
    for c, (d, w) in own.items():
        h = shared_turns(c)
        out[c] = (first[0][:h] + d[h:], first[1][:h] + w[h:])
    return base, out


def _path(digests: list[bytes]) -> list[bytes]:
    """Keys of the nodes that a conversation goes through, from the root."""
    keys = [ROOT]
    for d in digests:
        keys.append(hashlib.blake2b(keys[-1] + d, digest_size=16).digest())
    return keys


def _family_nodes(table: pa.Table) -> pa.Table:
    """A family's nodes with what its own members make of them; a member is told by its words from each depth on."""
    base, convs = _rebuilt(table)
    nodes: dict[bytes, list] = {}
    for c in sorted(convs):
        digests, words = convs[c]
        keys = _path(digests)
        for depth, key in enumerate(keys):
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = [base, key, keys[depth - 1] if depth else None, depth, words[depth - 1] if depth else 0, c, 0, 0, [], []]
            node[6] += 1
            node[9].append(c)
        node[7] += 1
        node[8].append(c)
    rows = [[*n[:8], ",".join(map(str, n[8])), np.array(n[9], np.int64).tobytes()] for n in nodes.values()]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW)


def _family_sums(table: pa.Table) -> pa.Table:
    """What a family's members add to each of its nodes, given all nodes' owners and whether they have children."""
    nodes = {k: (p, d, w, o, leaf, np.frombuffer(m, np.int64).tolist()) for k, p, d, w, o, leaf, m in zip(*(table.column(c).to_pylist() for c in ("node_key", "parent_key", "depth", "words", "all_owner", "childless", "members")), strict=True)}
    end: dict[int, bytes] = {}
    for key in sorted(nodes, key=lambda k: nodes[k][1]):
        for c in nodes[key][5]:
            end[c] = key
    sums = {key: [0, 0, 0] for key in nodes}
    for c, key in end.items():
        leaf = nodes[key][4] and nodes[key][3] == c
        last = nodes[key][1]
        beyond = distinct = 0  # words of the turns from here on, and of those that the conversation owns
        owned = last + 1  # the depth from which the conversation owns its nodes
        while key is not None:
            parent, depth, words, owner, _, _ = nodes[key]
            here = sums[key]
            here[0] += owned == depth + 1 <= last
            beyond += words
            if owner == c:
                owned = depth
                distinct += words
            here[1] += leaf
            here[2] += beyond - distinct
            key = parent
    rows = [(k, nodes[n[0]][3] if n[0] is not None else None, *sums[k]) for k, n in nodes.items()]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SUMS_ARROW, strict=True)], schema=_SUMS_ARROW)


def _hashed(batches):
    """Rows sorted by node and place become one digest a node; a node's ids go through, however many they are."""
    key, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ends in zip(batch.column("node_key").to_pylist(), batch.column("ends"), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ends.as_py().encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(key, running.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node_key", "ends_sha256"])


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(node_key, ends_sha256) of nodes at which conversations end: SHA-256 of their ids in order, joined by commas.

    Bases part the ids' order, so ids of near families are joined first; a node that very
    many conversations end at is then a stream of long pieces.
    """
    near = F.floor(F.col("base") / (FAMILY * NEAR)).alias("near")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",").alias("ends")
    pieces = nodes.filter("n_ends > 0").groupBy("node_key", near).agg(joined)
    return pieces.repartition("node_key").sortWithinPartitions("node_key", "near").mapInArrow(_hashed, "node_key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns of rebuilt conversations, the empty one too.

    Turns are ordered by number, null first, and of one number by a digest of role and
    text; null role or text is empty.  A conversation c is rebuilt as the first h turns
    of the base c - c % 20 (all if fewer, none if absent) and its own turns after its
    first h; h is crc32 of c in decimal, modulo 4.  Columns: node_key, parent_key,
    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members
    but one times words of the last text), ends_sha256 (ids of conversations that end
    there, in order, joined by commas).

    Rows without conv_id are left out; repeated rows are turns of their own; a turn is
    compared by 128 bits of SHA-256; very long texts are counted whole; other columns are
    ignored; an empty table gives no rows.  A conversation is in one task as 16 bytes a
    turn, a family with its nodes.
    """
    nodes = saved(turns_of(conversations).groupBy("base").applyInArrow(_family_nodes, _NODE))
    whole = nodes.groupBy("node_key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("owner").alias("all_owner"), F.sum("n_convs").alias("all_convs"), F.sum("n_ends").alias("all_ends"), F.count(F.lit(1)).alias("n_families"))
    whole = saved(whole)
    told = whole.select("node_key", "all_owner", (F.col("all_convs") == F.col("all_ends")).alias("childless"), "n_families")
    known = join_groups(nodes.select("base", "node_key", "parent_key", "depth", "words", "members"), told, "node_key", "n_families", nodes.count(), "base")
    parts = known.groupBy("base").applyInArrow(_family_sums, _SUMS)
    sums = parts.groupBy("node_key").agg(F.first("parent_owner").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    found = whole.join(sums, "node_key").join(_end_digests(nodes), "node_key", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("node_key", "parent_key", F.col("all_owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("all_convs").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def op12_conversation_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations).drop("node_key", "parent_key")


OP12_SQL = f"""WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, [coalesce(role, ''), coalesce(text, '')] AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {FAMILY} AS base, {crc32_sql("CAST(c AS VARCHAR)")} % {MOST_SHARED} AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT convs.c, i, t FROM convs JOIN turns ON turns.c = convs.base AND i <= h
  UNION ALL SELECT convs.c, i, t FROM convs JOIN turns ON turns.c = convs.c AND i > h),
paths AS (SELECT convs.c, coalesce(p, []) AS p FROM convs LEFT JOIN (SELECT c, list(t ORDER BY i) AS p FROM parts GROUP BY c) USING (c)),
steps AS (SELECT c, len(p) AS n, d, p[:d] AS prefix FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT prefix, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix)[-1][2], '[^\\x20\\x09-\\x0D]+')) END AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM steps GROUP BY prefix),
kin AS (SELECT a.prefix AS above, b.prefix AS below, b.n_convs, b.words, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.d = b.d + 1 AND k.prefix[:b.d] = b.prefix) AS leaf
  FROM (SELECT prefix, n_convs, words, d, unnest(range(d + 1)) AS u FROM nodes) b JOIN nodes a ON a.prefix = b.prefix[:b.u])
SELECT a.conv_id, a.d AS depth, (SELECT p.conv_id FROM nodes p WHERE a.d > 0 AND p.d = a.d - 1 AND p.prefix = a.prefix[:a.d - 1]) AS parent_conv_id, a.n_convs,
  (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.prefix[:a.d] = a.prefix) AS n_children,
  s.n_leaves, s.saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN (SELECT above, CAST(count(*) FILTER (WHERE leaf) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM kin GROUP BY above) s ON s.above = a.prefix"""
