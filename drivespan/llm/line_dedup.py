"""Line dedup with a log-template tree. DataFrame functions only.

Lines are parsed by a tree of fixed depth: the first level is the token count, the next ones the leading
tokens; tokens with digits, @, / or = are variable from the start and read <*>. A leaf's first template is what its lines
agree on: at a position whose most frequent token is held by at least CONSENSUS of them, that token, else <*>. A line
that agrees with it on at least SIMILAR of the tokens takes it. More templates follow in each leaf, each the most frequent kind
of line that is left, with the kinds that agree with it, until no two kinds are left that might agree. A template found in at least MIN_DOCS
documents recurs: its first line (least doc_id, then least line number) stays, every other is dropped. Lines of more than long_words words
recur from two documents on; of two lines in a leaf, a token must then be in both to be the template's.

Kinds that agree differ in few places, so cut into one block more than that, they share one: kinds that share no block with another
of their leaf are their own templates at once, and the rounds that follow are as many as a leaf has groups among the others.

Leaves and lines are known by 64-bit hashes beside their number of words; a line's own template by both hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from drivespan.llm.shared import free, written

#: Leading tokens on the way to a leaf.
DEPTH = 4
MIN_DOCS = 3
#: Lines of more words than this do not repeat by chance.
LONG_WORDS = 50
SIMILAR, CONSENSUS = 0.8, 0.5
#: Share of the words of two texts from which, with near-dedup to follow, one is a copy of the other.
COPIES = 0.8
VARIABLE = r"[^ \t]*[0-9@/=][^ \t]*"
LEAF = ["words", "leaf"]
TEMPLATE = [*LEAF, "turn", "own"]


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, text_hash, at, masked, words, leaf, own) of each line with words.

    masked has single spaces between its tokens and <*> for variable ones; most lines need neither change, and looking for one costs
    less than a replacement. leaf is the path in the tree, hashed: the token count and the leading tokens; own is the
    masked line, hashed. Each step is a projection of its own, so that no expression is computed twice.
    """
    lines = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.col("line")
    uneven = line.contains("  ") | line.contains("\t") | line.startswith(" ") | line.endswith(" ")
    lines = lines.filter(F.btrim("line", F.lit(" \t")) != "").select("doc_id", "text_hash", "at", F.when(uneven, F.trim(F.regexp_replace("line", "[ \t]+", " "))).otherwise(line).alias("even"))
    lines = lines.select("doc_id", "text_hash", "at", F.when(F.col("even").rlike("[0-9@/=]"), F.regexp_replace("even", VARIABLE, "<*>")).otherwise(F.col("even")).alias("masked"))
    spaces = F.octet_length("masked") - F.octet_length(F.replace(F.col("masked"), F.lit(" "), F.lit("")))
    return lines.select("doc_id", "text_hash", "at", "masked", (spaces + 1).alias("words"), F.xxhash64(spaces, F.substring_index("masked", " ", depth)).alias("leaf"), F.xxhash64("masked").alias("own"))


def _least(min_docs: int, long_words: int) -> Column:
    """Documents that a line or template of so many words must be in."""
    return F.when(F.col("words") > long_words, min(2, min_docs)).otherwise(min_docs)


def _allowed(words: Column, similar: float) -> Column:
    """Places in which two kinds that agree may differ."""
    return F.floor((1 - similar) * words + 1e-9)


def _meeting(kinds: DataFrame, depth: int, similar: float) -> DataFrame:
    """The kinds (words, leaf, own, masked, ...) that share a block of their tokens behind the leading ones with another kind of their leaf. No others can agree with one."""
    rest = F.slice(F.split("masked", " "), depth + 1, F.greatest(F.col("words") - depth, F.lit(0)).cast("int"))
    parts = (_allowed(F.col("words"), similar) + 1).cast("int")
    cut = kinds.select(*LEAF, "own", rest.alias("rest"), parts.alias("parts"))
    edge = lambda j: F.floor(j * F.size("rest") / F.col("parts")).cast("int")
    block = lambda j: F.xxhash64(j, F.array_join(F.slice("rest", edge(j) + 1, edge(j + 1) - edge(j)), " "))
    blocks = cut.select(*LEAF, "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block)).alias("block"))
    met = blocks.groupBy(*LEAF, "block").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a <> b").select(*LEAF, "block")
    some = blocks.join(met.hint("merge"), [*LEAF, "block"], "left_semi").select(*LEAF, "own").distinct()
    return kinds.join(some.hint("merge"), [*LEAF, "own"], "left_semi")


def templates(docs: DataFrame, lines: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: float = SIMILAR, consensus: float = CONSENSUS, long_words: int = LONG_WORDS) -> DataFrame:
    """(words, leaf, own, turn) of the lines that take one of their leaf's templates, by its number. lines: (doc_id, at, words, leaf, own) of all lines of docs.

    All joins are merge joins, as leaves with several kinds grow with the lines. What stands on the far side is a written table, so that a leaf with very
    many lines meets it straight from a shuffle, which the skew join can split.
    """
    # a leaf with one kind of line, or in too few documents, has nothing to generalise
    wide = lines.groupBy(*LEAF).agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min("doc_id").alias("c"), F.max("doc_id").alias("d"), F.count("*").alias("n")).filter("a <> b and c <> d").filter(F.col("n") >= _least(min_docs, long_words)).select(*LEAF)
    wide = written(wide, "line-leaves")
    kinds = _lines(docs, depth).select(*LEAF, "own", "masked").join(wide.hint("merge"), LEAF, "left_semi").groupBy(*LEAF, "own").agg(F.count("*").alias("n"), F.first("masked").alias("masked"))
    left = written(kinds.select(*LEAF, "own", "n", "masked"), "line-kinds")
    votes = left.select(*LEAF, "n", F.posexplode(F.split("masked", " ")).alias("pos", "token")).groupBy(*LEAF, "pos", "token").agg(F.sum("n").alias("n"))
    top = votes.groupBy(*LEAF, "pos").agg(F.max(F.struct(F.col("n"), F.col("token"))).alias("top"), F.sum("n").alias("all"))
    enough = F.when((F.col("words") <= long_words) | (F.col("all") > 2), consensus * F.col("all")).otherwise(2)
    shape = top.groupBy(*LEAF).agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("top.n") >= enough, F.col("top.token")).alias("token")))).alias("s")).select(*LEAF, F.col("s.token").alias("shape"))
    found, turn = [], 0
    while True:
        shape = written(shape, "line-shapes")
        if turn and not shape.head(1):
            return reduce(DataFrame.unionByName, found)
        same = F.size(F.filter(F.zip_with(F.split("masked", " "), "shape", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        met = written(left.join(shape.hint("merge"), LEAF).withColumn("fits", F.col("words") - same <= _allowed(F.col("words"), similar)).drop("shape"), "line-met")
        found.append(met.filter("fits").select(*LEAF, "own", F.lit(turn).alias("turn")))
        left = met.filter("not fits").drop("fits")
        if not turn:
            left = written(_meeting(left, depth, similar), "line-left")
        shape = left.groupBy(*LEAF).agg(F.max(F.struct("n", "masked")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1").select(*LEAF, F.split("top.masked", " ").alias("shape"))
        turn += 1


def _copies(met: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """(doc_id, text_hash, kin): texts that are a copy of an earlier document, and the first of the documents that such links reach.

    met: (doc_id, text_hash, words, first, recurs) of lines whose template several documents have. A text is a copy if the words of its lines whose templates are first in that document are `share` of both, what either has of recurring lines
    from elsewhere left out.
    """
    own = F.col("doc_id") == F.col("first.doc_id")
    per = met.groupBy("doc_id", "text_hash", F.col("first.doc_id").alias("from")).agg(F.sum("words").alias("s"), F.sum(F.when(F.col("recurs") & ~own, F.col("words")).otherwise(0)).alias("r"))
    per = written(per, "line-shares")
    lost = per.groupBy("doc_id", "text_hash").agg(F.sum("r").alias("lost"), F.max_by(F.struct("from", "s", "r"), F.when(F.col("from") < F.col("doc_id"), F.struct("s", -F.col("from")))).alias("most"))
    known = written(sizes.join(lost.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "most", (F.col("size") - F.coalesce("lost", F.lit(0))).alias("left")), "line-sizes")
    # of rows that repeat an id the largest stands for it
    other = known.groupBy(F.col("doc_id").alias("from")).agg(F.max("left").alias("other"))
    links = known.filter("most is not null").select("doc_id", "text_hash", F.col("most.from").alias("from"), F.col("most.s").alias("s"), (F.col("left") + F.col("most.r")).alias("left")).join(other.hint("merge"), "from")
    at = links.filter(F.col("s") >= share * F.greatest("left", "other")).select("doc_id", "text_hash", F.col("from").alias("kin"))
    while True:  # links go to lesser ids; each round doubles how far a text has gone
        at = written(at, "line-kin")
        on = at.groupBy(F.col("doc_id").alias("kin")).agg(F.min("kin").alias("further"))
        met = written(at.join(on.hint("merge"), "kin", "left"), "line-kin-met")
        at = met.select("doc_id", "text_hash", F.coalesce("further", "kin").alias("kin"))
        if met.filter("further is not null").isEmpty():
            return at


def dropped_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: float = SIMILAR, consensus: float = CONSENSUS, long_words: int = LONG_WORDS, copies: float | None = None) -> DataFrame:
    """(doc_id, text_hash, at): the lines of recurring templates but for each template's first."""
    parsed = written(_lines(docs, depth).drop("masked"), "lines")
    general = written(templates(docs, parsed, depth, min_docs, similar, consensus, long_words), "line-general")
    lines = parsed.join(general.hint("merge"), [*LEAF, "own"], "left")
    lines = lines.select("doc_id", "text_hash", "at", *LEAF, F.coalesce("turn", F.lit(-1)).alias("turn"), F.when(F.col("turn").isNull(), F.col("own")).otherwise(0).alias("own"))
    lines = written(lines, "line-templates")
    place = F.struct("doc_id", "text_hash", "at")
    recurs = F.col("docs") >= _least(min_docs, long_words)
    found = lines.groupBy(*TEMPLATE).agg(F.countDistinct("doc_id").alias("docs"), F.min(place).alias("first"))
    if copies is None:
        recurring = written(found.filter(recurs).select(*TEMPLATE, "first"), "line-recurring")
        return lines.join(recurring.hint("merge"), TEMPLATE).filter(place != F.col("first")).select("doc_id", "text_hash", "at").distinct()
    shared = written(found.filter("docs > 1").select(*TEMPLATE, "first", recurs.alias("recurs")), "line-shared")
    met = written(lines.join(shared.hint("merge"), TEMPLATE).select("doc_id", "text_hash", "at", "words", "first", "recurs"), "line-met-again")
    kin = written(_copies(met, lines.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("size")), copies), "line-copies")
    gone = met.filter("recurs").filter(place != F.col("first")).select("doc_id", "text_hash", "at", "first")
    whose = kin.groupBy(F.col("doc_id").alias("first_id")).agg(F.min("kin").alias("first_kin"))
    gone = gone.withColumn("first_id", F.col("first.doc_id")).join(kin.hint("merge"), ["doc_id", "text_hash"], "left").join(whose.hint("merge"), "first_id", "left")
    # a copy keeps what is first in its own group of copies; the first document itself keeps one of each
    stays = F.col("kin").isNotNull() & (F.col("kin") == F.coalesce("first_kin", "first_id")) & (F.col("doc_id") != F.col("first_id"))
    return gone.filter(~stays).select("doc_id", "text_hash", "at").distinct()


def dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: float = SIMILAR, consensus: float = CONSENSUS, long_words: int = LONG_WORDS, copies: float | None = None) -> DataFrame:
    """docs with the lines of recurring templates taken out of text, and n_lines and n_dropped.

    With `copies`, a text that shares that much of its words, and of the other's, with one earlier document (what both have from third documents left out) is a copy of it as a whole: it keeps the lines that are first in
    its group of copies, for near-dedup to judge, and loses what recurs from elsewhere, as the others of its group do.

    Columns of those two names are replaced. Null texts stay null with no lines, a text whose lines all go becomes
    empty, no row is dropped. Lines without words are never dropped. Rows with a null doc_id are left as they are; rows that repeat a doc_id
    count as one document for a template's documents, but each text loses its own lines; rows equal in both lose the same lines. Ties for the first line
    go to the least line number; the most frequent token of a position, or kind of a leaf, to the greatest.
    """
    own = docs.drop("n_lines", "n_dropped")
    gone_at, id_, hash_, left_, n_lines, n_dropped = free([*own.columns, "n_lines", "n_dropped"], "gone", "id", "hash", "left", "lines_read", "lines_gone")
    gone = dropped_lines(docs.select("doc_id", "text"), depth, min_docs, similar, consensus, long_words, copies).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias(gone_at))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), gone_at)
    kept = own.join(gone.hint("merge"), (own["doc_id"] == gone[id_]) & (F.xxhash64(own["text"]) == gone[hash_]), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_at))
    kept = kept.withColumn(left_, F.when(F.col(gone_at).isNotNull(), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))
    kept = kept.withColumns({n_lines: n, n_dropped: F.coalesce(F.array_size(gone_at), F.lit(0))})
    return kept.select(*(F.coalesce(left_, "text").alias(c) if c == "text" else F.col(f"`{c}`") for c in own.columns), F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


_TOKENS = r"list_filter(string_split_regex(regexp_replace(line, '[^ \t]*[0-9@/=][^ \t]*', '<*>', 'g'), '[ \t]+'), lambda x: x <> '')"
_LEAST = f"CASE WHEN max(len(tokens)) > {LONG_WORDS} THEN {min(2, MIN_DOCS)} ELSE {MIN_DOCS} END"
_AGREES = f"len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = lead[i])) >= {SIMILAR} * len(tokens)"
ORACLE_SQL = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tok AS (SELECT doc_id, ln, {_TOKENS} AS tokens FROM raw),
lines AS (SELECT doc_id, ln, tokens, len(tokens) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf, array_to_string(tokens, ' ') AS own FROM tok WHERE len(tokens) > 0),
wide AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT own) > 1 AND count(DISTINCT doc_id) > 1 AND count(*) >= {_LEAST}),
kinds AS (SELECT leaf, own, count(*) AS n, any_value(tokens) AS tokens FROM lines WHERE leaf IN (SELECT leaf FROM wide) GROUP BY leaf, own),
cells AS (SELECT leaf, n, len(tokens) AS words, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kinds),
votes AS (SELECT leaf, words, pos, token, sum(n) AS n FROM cells GROUP BY ALL),
tops AS (SELECT leaf, words, pos, token, n, sum(n) OVER (PARTITION BY leaf, pos) AS total, row_number() OVER (PARTITION BY leaf, pos ORDER BY n DESC, token DESC) AS r FROM votes),
fixed AS (SELECT leaf, pos, token FROM tops WHERE r = 1 AND n >= CASE WHEN words <= {LONG_WORDS} OR total > 2 THEN {CONSENSUS} * total ELSE 2 END),
sim AS (SELECT c.leaf, c.own, count(f.token) AS same, count(*) AS total
        FROM (SELECT leaf, own, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kinds) c
        LEFT JOIN fixed f ON f.leaf = c.leaf AND f.pos = c.pos AND f.token = c.token GROUP BY c.leaf, c.own),
fits0 AS (SELECT leaf, own, 0 AS turn FROM sim WHERE same >= {SIMILAR} * total),
led(leaf, own, n, tokens, turn, fits) AS (
  SELECT leaf, own, n, tokens, 0, false FROM kinds ANTI JOIN fits0 USING (leaf, own)
  UNION ALL
  SELECT leaf, own, n, tokens, turn, {_AGREES}
  FROM (SELECT leaf, own, n, tokens, turn + 1 AS turn, first_value(tokens) OVER (PARTITION BY leaf ORDER BY n DESC, own DESC) AS lead FROM led WHERE NOT fits)),
general AS (FROM fits0 UNION ALL SELECT leaf, own, turn FROM led WHERE fits),
named AS (SELECT l.doc_id, l.ln, l.tokens, CASE WHEN s.own IS NOT NULL THEN 'leaf ' || s.turn || ' ' || l.leaf ELSE 'own ' || l.leaf || chr(10) || l.own END AS template
          FROM lines l LEFT JOIN general s ON s.leaf = l.leaf AND s.own = l.own),
firsts AS (SELECT template, min(ROW(doc_id, ln)) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= {_LEAST}),
gone AS (SELECT DISTINCT n.doc_id, n.ln FROM named n JOIN firsts f ON f.template = n.template WHERE ROW(n.doc_id, n.ln) <> f.first),
kept AS (SELECT r.doc_id, count(*) AS n_lines, count(g.ln) AS n_dropped, coalesce(string_agg(r.line, chr(10) ORDER BY r.ln) FILTER (WHERE g.ln IS NULL), '') AS text
         FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.ln = r.ln GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS INTEGER) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
