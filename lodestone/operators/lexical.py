"""The full-text index and BM25 search over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.tokens import tokens
from lodestone.plans.grammar import COLUMNS, Bool, Near, Node, Phrase, leaves, parse

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Postings of a partition, about: few enough to be sorted or grouped in memory. A chunk has some 128 of them.
PART, PART_CHUNKS = 1 << 20, 1 << 13
_EMPTY = "array<int>"


def searchable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, text, title, page_id, space_key): what the index has of each chunk."""
    docs = documents.select(F.col("id").alias("document_id"), "title", "page_id", "space_key")
    return chunks.join(docs, "document_id").select(F.col("id").alias("chunk_id"), *COLUMNS)


def postings(rows: DataFrame) -> DataFrame:
    """(chunk_id, col, term, positions) of rows(chunk_id, text, title, page_id, space_key).

    The tokens of a column are grouped in its own row: sorted by term and position, and cut where the term
    changes. So nothing is shuffled, and no row is made of a single token.
    """
    cols = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("words")) for c in COLUMNS))
    each = rows.select("chunk_id", F.explode(cols).alias("c")).filter(F.size("c.words") > 0)
    each = each.select("chunk_id", "c.col", F.sort_array(F.transform("c.words", lambda w, i: F.struct(w.alias("term"), i.alias("pos")))).alias("s"))

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"])

    each = each.select("chunk_id", "col", "s", F.filter(F.sequence(F.lit(0), F.size("s") - 1), begins).alias("first"))

    def group(i: Column, k: Column) -> Column:
        own = F.slice("s", i + 1, F.coalesce(F.get("first", k + 1), F.size("s")) - i)
        return F.struct(F.get("s", i)["term"].alias("term"), F.transform(own, lambda x: x["pos"]).alias("positions"))

    return each.select("chunk_id", "col", F.explode(F.transform("first", group)).alias("p")).select("chunk_id", "col", "p.term", "p.positions")


def laid_out(posting: DataFrame, chunks: int) -> DataFrame:
    """Postings of so many chunks in ranges of (term, chunk), so that a frequent term spreads over several, each sorted and of bounded size."""
    return posting.repartitionByRange(max(1, -(-chunks // PART_CHUNKS)), "term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def lengths(rows: DataFrame) -> DataFrame:
    """(chunk_id, n_tokens): tokens of all columns together."""
    total = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS[1:]), F.size(tokens(F.coalesce(F.col(COLUMNS[0]), F.lit("")))))
    return rows.select("chunk_id", total.alias("n_tokens"))


def corpus_stats(length: DataFrame) -> DataFrame:
    """One row (n_rows long, avg_tokens double)."""
    return length.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n_tokens").alias("avg_tokens"))


def document_frequencies(posting: DataFrame) -> DataFrame:
    """(term, n_chunks, n_occurrences). A task groups PART postings, about, however many there are."""
    rows = posting.select("term", "chunk_id", F.size("positions").alias("n")).repartition(max(1, -(-posting.count() // PART)), "term", "chunk_id")
    each = rows.groupBy("term", "chunk_id").agg(F.sum("n").alias("n"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_occurrences"))


def _matches(phrase: Phrase, k: int) -> Column:
    word = phrase.tokens[k]
    if phrase.prefix and k == len(phrase.tokens) - 1:
        return F.col("term").startswith(word)
    return F.col("term") == word


def _all_of(ps: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, ps)


def _near(starts: list[Column], sizes: list[int], distance: int, i: int) -> Column:
    """Places of phrase i that belong to a stretch with every phrase, at most `distance` tokens between the first's end and the last's start."""

    def fits(x: Column, size: int, s: Column) -> Column:
        return (s <= x) & (s + size + distance >= x)

    def one(start: Column, size: int, x: Column) -> Column:
        return F.exists(start, lambda s: fits(x, size, s))

    ends = F.array_distinct(F.flatten(F.array(*starts)))
    good = F.filter(ends, lambda x: _all_of([one(start, size, x) for start, size in zip(starts, sizes)]))
    return F.filter(starts[i], lambda s: F.exists(good, lambda x: fits(x, sizes[i], s)))


def _followed(at: Column, words: Column, k: int) -> Column:
    return F.filter(at, lambda x: F.array_contains(words, x + k))


def score(posting: DataFrame, length: DataFrame, stats: DataFrame, query: str | Node) -> DataFrame:
    """(chunk_id, score) of the chunks that match the query; higher is better.

    Statistics are those of all rows; a phrase's document frequency counts the rows that have it in the
    columns it is restricted to. The postings are read once, only for the query's terms; two aggregations
    on the chunk follow, and the rest is arithmetic on one row a matching chunk.
    """
    tree = parse(query) if isinstance(query, str) else query
    groups = leaves(tree)
    phrases = [p for g in groups for p in g.phrases]
    if not phrases or any(not p.columns for p in phrases) and all(not p.columns for p in phrases):
        return length.select("chunk_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    wanted = {(p.tokens[k], p.prefix and k == len(p.tokens) - 1): _matches(p, k) for p in phrases for k in range(len(p.tokens))}
    exact = [w for w, prefix in wanted if not prefix]
    term = [F.col("term").isin(exact)] if exact else []
    term += [m for (_, prefix), m in wanted.items() if prefix]
    rows = posting.filter(reduce(lambda a, b: a | b, term))
    distinct: list[Phrase] = list(dict.fromkeys(phrases))
    parts = {(i, k): F.flatten(F.collect_list(F.when(_matches(p, k) & F.col("col").isin(*p.columns), F.col("positions")))) for i, p in enumerate(distinct) for k in range(len(p.tokens)) if p.columns}
    by_col = rows.groupBy("chunk_id", "col").agg(*(c.alias(f"w{i}_{k}") for (i, k), c in parts.items()))

    def places(i: int) -> Column:
        p = distinct[i]
        if not p.columns:
            return F.array().cast(_EMPTY)
        at = F.array_sort(F.array_distinct(F.col(f"w{i}_0")))
        if p.initial:
            at = F.filter(at, lambda x: x == 0)
        for k in range(1, len(p.tokens)):
            at = _followed(at, F.col(f"w{i}_{k}"), k)
        return at

    by_col = by_col.select("chunk_id", *(places(i).alias(f"p{i}") for i in range(len(distinct))))
    sums = [F.sum(F.size(f"p{i}")).alias(f"n{i}") for i in range(len(distinct))]
    for g, group in enumerate(groups):
        if len(group.phrases) > 1:
            which = [distinct.index(p) for p in group.phrases]
            starts, sizes = [F.col(f"p{i}") for i in which], [len(p.tokens) for p in group.phrases]
            sums += [F.sum(F.size(_near(starts, sizes, group.distance, j))).alias(f"g{g}_{j}") for j in range(len(which))]
    found = by_col.groupBy("chunk_id").agg(*sums)
    df = found.agg(*(F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))))

    counts: list[tuple[int, Column]] = []
    hits: list[Column] = []
    for g, group in enumerate(groups):
        own = [F.col(f"g{g}_{j}") if len(group.phrases) > 1 else F.col(f"n{distinct.index(p)}") for j, p in enumerate(group.phrases)]
        counts += [(distinct.index(p), c) for p, c in zip(group.phrases, own)]
        hits.append(_all_of([c > 0 for c in own]))
    it = iter(hits)

    def holds(node: Node) -> Column:
        if isinstance(node, Near):
            return next(it)
        if node.left is None or node.right is None:  # a side without tokens matches nothing
            side = holds(node.left) if node.left else holds(node.right) if node.right else F.lit(False)
            keeps = node.op == "OR" or node.op == "NOT" and node.left is not None
            return side if keeps else F.lit(False)
        a, b = holds(node.left), holds(node.right)
        return a & b if node.op == "AND" else a | b if node.op == "OR" else a & ~b

    matched = found.filter(holds(tree)).join(length, "chunk_id").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(stats))  # one row each
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens"))
    total = F.lit(0.0)
    for i, f in counts:
        idf = F.log((F.col("n_rows") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + F.when(f > 0, F.when(idf <= 0, LEAST_IDF).otherwise(idf) * (f * (K1 + 1) / (f + norm))).otherwise(0.0)
    return matched.select("chunk_id", total.alias("score"))


__all__ = ["Bool", "corpus_stats", "document_frequencies", "laid_out", "lengths", "parse", "postings", "score", "searchable"]
