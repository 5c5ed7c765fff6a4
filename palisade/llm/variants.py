"""Spelling variants of a corpus's words: each word's near words, and the much more frequent one it stands for.

1. Words are counted: maximal runs of Latin letters, A-Z in lower case. Where 31 divides the checksum of ``<doc_id>:<run>``, one code
   point is left out, so that there are misspellings to find. Words have ``SHORTEST`` code points and ``LEAST`` occurrences at least.
2. Words stand in a frequency-vector trie: level 0 is the number of all letters, each further level the number of
   letters in a part of one of the cells that the levels above have made (``LEVELS``). One inserted, deleted or replaced code point
   adds at most one letter to one cell and takes at most one from another. So a depth-first search spends a budget of one
   surplus and one deficit, and meets every near word; each pair from one side only: from the shorter word, or at the first
   level that tells them apart from the word with fewer letters there.
3. Spark routes the top of that search: nodes with over ``CROWD`` words are opened level by level, and words travel on to
   the children that their budget reaches. What is left are shards of at most ``CROWD`` words and their visitors, in
   blocks of about ``BLOCK`` visitors, however many come. A task searches the rest of the trie (numpy arrays, a stack of
   frontiers) and verifies the words of the leaves. Nodes that are crowded below the last level (the same letters in another order)
   go by the strings that are left without one code point: near words share exactly one of them.
4. A word's form is its near word of largest n (ties: the smallest) if that n is ``TIMES`` its own; forms are followed to the last
   by doubling.

NULL and empty texts have no words. A NULL doc_id counts as an empty one in the checksum. Repeated rows count as often as they come.
An empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from palisade.session import materialise

from .common import bytes_of, ragged, whole_texts

SHORTEST, LEAST, TIMES, DROPS = 7, 2, 10, 31
CROWD, BLOCK = 100_000, 200_000
#: Fixed value: the letters from frequent to rare, as cells are halved by dealing them in turn.
BY_FREQUENCY = "etaoinsrhldcumfgpwybvkxjqz"
DEPTH = 20
#: Visitors that one search begins with; states and bytes of pairs that one of its steps holds.
AT_ONCE, FRONTIER, PAIRS = 20_000, 400_000, 1 << 20


def nested_cells(letters: str, depth: int) -> list[tuple[int, str]]:
    """(parent cell, letters) of each level: level 0 counts all; level k cuts cell k off its parent, which keeps what is left."""
    levels, cells = [(-1, "")], [(0, letters)]
    while cells and len(levels) < depth:
        cell, own = cells.pop(0)
        if len(own) > 1:
            cells += [(cell, own[0::2]), (len(levels), own[1::2])]
            levels.append((cell, own[1::2]))
    return levels


LEVELS = nested_cells(BY_FREQUENCY, DEPTH)


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) over all texts."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    found = whole_texts(docs).select("doc_id", F.explode(runs).alias("run"))
    run, size = F.col("run"), F.length("word")
    plain = F.octet_length(run) == F.length(run)
    lower = F.when(plain, F.lower(run)).otherwise(F.translate(run, ascii_uppercase, ascii_lowercase))
    found = found.select("doc_id", lower.alias("word"))
    found = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % size).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
    words = found.select(F.when(F.col("h") % DROPS == 0, less).otherwise(F.col("word")).alias("word"))
    return words.where(size >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ── the top of the search, as Spark joins ───────────────────────────


def _letters(level: int) -> Column:
    size = F.length("word")
    return size if level == 0 else size - F.length(F.translate("word", LEVELS[level][1], ""))


def _moves(level: int) -> Column:
    """What one level may add or take, and the cells of surplus and deficit then (-1: not spent)."""
    plus, minus, none = F.col("plus"), F.col("minus"), F.lit(-1)

    def move(delta: int, p: Column, m: Column) -> Column:
        return F.struct(F.lit(delta).alias("delta"), p.cast("int").alias("plus"), m.cast("int").alias("minus"))

    stay = move(0, plus, minus)
    if level == 0:
        return F.array(stay, move(1, F.lit(0), none))
    cell, new = F.lit(LEVELS[level][0]), F.lit(level)
    return (
        F.when(plus == cell, F.array(stay, move(1, new, minus)))
        .when(minus == cell, F.array(stay, move(-1, plus, new)))
        .when((plus == none) & (minus == none), F.array(stay, move(1, new, cell)))
        .otherwise(F.array(stay))
    )


def _without_one(word: Column) -> Column:
    """The word itself, and every string it leaves without one code point."""
    size = F.length(word)
    less = F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, size)))
    return F.array_distinct(F.concat(F.array(word), less))


def shards(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(node, word, n, member): members belong to the node, the others visit it."""
    if words.count() <= crowd:
        return words.select(F.lit(0).cast("long").alias("node"), "word", "n", F.lit(True).alias("member"))
    spent = F.col("plus") + F.col("minus")  # -2: a word on its own path
    going = words.select("word", "n", F.lit(0).cast("long").alias("node"), F.lit(-1).alias("plus"), F.lit(-1).alias("minus"))
    out = None
    for level in range(len(LEVELS)):
        going = going.select("word", "n", "node", _letters(level).alias("letters"), F.explode(_moves(level)).alias("move"))
        node = F.xxhash64("node", F.lit(level), F.col("letters") + F.col("move.delta"))
        states = materialise(going.select("word", "n", node.alias("node"), "move.plus", "move.minus"), "states")
        sizes = states.where(spent == -2).groupBy("node").agg(F.count("*").alias("n"))
        crowded = materialise(sizes.where(F.col("n") > crowd).select("node"), "crowded")
        done = states.join(crowded, "node", "left_anti").select("node", "word", "n", (spent == -2).alias("member"))
        out = done if out is None else out.union(done)
        if crowded.isEmpty():
            return out
        going = states.join(crowded, "node")
    rest = going.select("node", "word", "n", (spent == -2).alias("member"), F.explode(_without_one(F.col("word"))).alias("less"))
    return out.union(rest.select(F.xxhash64("node", "less").alias("node"), "word", "n", "member"))


def blocks(routed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, salt, word, n, member, visitor): members stand in every block of their node's visitors."""
    sizes = materialise(routed.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.max("member").alias("any")), "sizes")
    rows = routed.join(sizes.where("any").drop("any"), "node")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own)
    salts = F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("salt", F.explode(salts))
    return rows.select("node", "salt", "word", "n", "member", (F.col("salt") == F.col("own")).alias("visitor"))


# ── the rest of it, in a task ───────────────────────────────────────


class _Words:
    """Words as bytes of Latin-1, and their letters at each level."""

    def __init__(self, column: pa.Array):
        self.size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = np.frombuffer(bytes_of(column)[0].tobytes().decode().encode("latin-1"), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.empty((len(LEVELS), len(self.size)), np.int64)
        for level, (_, own) in enumerate(LEVELS):
            listed = np.zeros(256, np.int64)
            listed[list(own.encode())] = 1
            self.letters[level] = np.add.reduceat(listed[self.data], self.start) if level else self.size
        three = np.arange(3)
        self.ends = [
            self.data[np.minimum(first[:, None] + sign * three, len(self.data) - 1)].astype(np.int32) @ np.array([1, 256, 65536], np.int32)
            for first, sign in ((self.start, 1), (self.start + self.size - 1, -1))
        ]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of different words differ by one code point: all but one of the longer's are common to both ends.
        Of words with six code points or more, the first three or the last three must be alike."""
        out = np.zeros(len(a), bool)
        likely = np.flatnonzero((np.minimum(self.size[a], self.size[b]) < 6) | (self.ends[0][a] == self.ends[0][b]) | (self.ends[1][a] == self.ends[1][b]))
        order = likely[np.argsort(-np.maximum(self.size[a], self.size[b])[likely], kind="stable")]
        at = 0
        while at < len(order):
            x, y = a[order[at]], b[order[at]]
            width = int(max(self.size[x], self.size[y]))
            part = order[at : at + max(1, PAIRS // width)]
            x, y, steps = a[part], b[part], np.arange(width)
            common = np.zeros(len(part), np.int64)
            for first, sign in ((self.start, 1), (self.start + self.size - 1, -1)):
                cells = []
                for of, beyond in ((x, 0), (y, 1)):
                    inside = steps < self.size[of][:, None]
                    cells.append(np.where(inside, self.data[np.where(inside, first[of][:, None] + sign * steps, 0)], beyond))
                apart = cells[0] != cells[1]
                common += np.where(apart.any(axis=1), apart.argmax(axis=1), width)
            out[part] = common >= np.maximum(self.size[x], self.size[y]) - 1
            at += len(part)
        return out


def _search(words: _Words, members: np.ndarray, visitors: np.ndarray):
    """Pairs (visitor, member) whose letters are within the budget, in pieces; ``same`` tells those with equal letters."""
    wide = int(words.letters.max()) + 3
    nodes, keys = np.zeros(len(members), np.int64), []
    for level in range(len(LEVELS)):
        key, nodes = np.unique(nodes * wide + words.letters[level][members], return_inverse=True)
        keys.append(key)
    by_leaf = np.argsort(nodes, kind="stable")
    leaves = np.searchsorted(nodes[by_leaf], np.arange(len(keys[-1]) + 1))
    ordered = visitors[np.lexsort(words.letters[:, visitors][::-1])]  # neighbours look in near places
    for lo in range(0, len(ordered), AT_ONCE):
        one = ordered[lo : lo + AT_ONCE]
        none = np.full(len(one), -1, np.int8)
        waiting = [(0, one, np.zeros(len(one), np.int64), none, none)]
        while waiting:
            level, of, node, plus, minus = waiting.pop()
            if level == len(LEVELS):
                yield from _leaf_pairs(members[by_leaf], leaves, of, node, (plus < 0) & (minus < 0))
                continue
            if len(of) > FRONTIER:
                half = len(of) // 2
                waiting += [(level, *(x[half:] for x in (of, node, plus, minus))), (level, *(x[:half] for x in (of, node, plus, minus)))]
                continue
            cell = LEVELS[level][0]
            fresh = np.flatnonzero((plus < 0) & (minus < 0))
            more, less = (fresh[:0], fresh[:0]) if level == 0 else (np.flatnonzero(plus == cell), np.flatnonzero(minus == cell))
            pick = np.concatenate([np.arange(len(of)), fresh, more, less])
            delta = np.zeros(len(pick), np.int64)
            delta[len(of) : len(pick) - len(less)], delta[len(pick) - len(less) :] = 1, -1
            now_plus, now_minus = plus[pick], minus[pick]
            now_plus[len(of) : len(pick) - len(less)] = level
            if level:
                now_minus[len(of) : len(of) + len(fresh)] = cell
            now_minus[len(pick) - len(less) :] = level
            want = node[pick] * wide + words.letters[level][of[pick]] + delta
            place = np.minimum(np.searchsorted(keys[level], want), len(keys[level]) - 1)
            hit = np.flatnonzero(keys[level][place] == want)
            if len(hit):
                waiting.append((level + 1, of[pick[hit]], place[hit], now_plus[hit], now_minus[hit]))


def _leaf_pairs(members: np.ndarray, leaves: np.ndarray, of: np.ndarray, node: np.ndarray, same: np.ndarray):
    lengths = leaves[node + 1] - leaves[node]
    ends, at = np.cumsum(lengths), 0
    while at < len(of):  # in pieces of about FRONTIER pairs; one visitor's leaf has at most all members
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
        part = slice(at, to)
        yield np.repeat(of[part], lengths[part]), members[ragged(leaves[node[part]], lengths[part])], np.repeat(same[part], lengths[part])
        at = to


_FOUND = "word string, n_near long, form_n long, form string"


def _near_in_block(table: pa.Table) -> pa.Table:
    """Of each word with a near word in the block: how many, and the most frequent of them."""
    table = table.combine_chunks()
    member, visitor = (np.flatnonzero(table.column(c).to_numpy()) for c in ("member", "visitor"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    if not len(member) or not len(visitor):
        return schema.empty_table()
    column, n = table.column("word").chunk(0), table.column("n").to_numpy()
    words = _Words(column)
    by_word = np.empty(len(n), np.int64)
    by_word[pc.sort_indices(column).to_numpy()] = np.arange(len(n))
    liked = np.lexsort([by_word, -n])
    rank = np.empty(len(n), np.int64)
    rank[liked] = np.arange(len(n))
    count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
    for a, b, same in _search(words, member, visitor):
        keep = np.flatnonzero(~same | (by_word[a] < by_word[b]))
        a, b = a[keep], b[keep]
        near = words.near(a, b)
        a, b = a[near], b[near]
        for one, other in ((a, b), (b, a)):
            count += np.bincount(one, minlength=len(n))
            np.minimum.at(best, one, rank[other])
    found = np.flatnonzero(count)
    form = liked[best[found]]
    return pa.table([column.take(pa.array(found)), pa.array(count[found]), pa.array(n[form]), column.take(pa.array(form))], schema=schema)


def near_words(words: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): of each word that has near words their number, and (-n, word) of the most frequent."""
    found = blocks(shards(words, crowd), block).groupBy("node", "salt").applyInArrow(_near_in_block, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in ``forms`` (word, form): what they lead to in the end."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        met = materialise(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = met.drop("moved")
        if met.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    words = materialise(word_counts(docs), "words")
    near = near_words(words, crowd, block)
    own = -F.col("best.less") >= TIMES * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(own, F.col("best.form")).alias("form"),
        F.when(own, -F.col("best.less")).alias("form_n"),
    )
    judged = materialise(judged, "judged")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
