"""Names, relations and scores over whole texts."""

import re

from pyspark.sql import functions as F

from ..catalog import frame, run_sql
from ..operators import intervals, phrases
from ..workspace import Workspace
from .registry import query, sql  # noqa: F401

# surfaces of 1 to 8 words: what opens a conversation, from its word number conv_id % 5
_SURFACES = """SELECT conv_id AS node, array_join(slice(filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> ''), CAST(1 + conv_id % 5 AS INT), CAST(1 + conv_id % 8 AS INT)), ' ') AS surface
  FROM {conversations} WHERE turn = 0"""
_SURFACES_DUCK = r"""surfaces AS (SELECT s AS surface, min(conv_id) AS node FROM (SELECT conv_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1 + conv_id % 5:conv_id % 5 + 1 + conv_id % 8], ' ') AS s
  FROM conversations WHERE turn = 0) WHERE length(s) >= 3 GROUP BY s)"""


@query(
    "c19_linked_spans",
    rf"""WITH RECURSIVE {_SURFACES_DUCK},
 x AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS w, regexp_split_to_array(lower(text), '[\p{{L}}\p{{N}}]+') AS g FROM conversations WHERE text IS NOT NULL),
 l AS (SELECT *, list_transform(w, lambda v: length(v)) AS wl, list_transform(g, lambda v: length(v)) AS gl FROM x WHERE len(w) > 0),
 c AS (SELECT conv_id, turn, i, i + n AS j, surface, node, CAST(list_sum(gl[1:i]) + coalesce(list_sum(wl[1:i - 1]), 0) AS INT) AS start, CAST(list_sum(gl[1:i + n - 1]) + list_sum(wl[1:i + n - 1]) AS INT) AS stop
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM l) p, (SELECT unnest(range(1, 9)) AS n) q JOIN surfaces ON surface = array_to_string(w[i:i + n - 1], ' ')
  WHERE i + n - 1 <= len(w)),
 o AS (SELECT conv_id, turn, list(struct_pack(s := -length(surface), i := i, j := j, start := start, stop := stop, surface := surface, node := node) ORDER BY -length(surface), i) AS k FROM c GROUP BY conv_id, turn),
 r(conv_id, turn, k, pos, kept) AS (SELECT conv_id, turn, k, 0, CAST([] AS INT[]) FROM o
  UNION ALL SELECT conv_id, turn, k, pos + 1, CASE WHEN len(list_filter(kept, lambda y: k[y].i < k[pos + 1].j AND k[pos + 1].i < k[y].j)) > 0 THEN kept ELSE list_append(kept, pos + 1) END FROM r WHERE pos < len(k)),
 f AS (SELECT conv_id, turn, k[unnest(kept)] AS h FROM r WHERE pos = len(k))
 SELECT conv_id, turn, h.start AS start, h.stop AS stop, h.surface AS surface, h.node AS node FROM f""",
)
def linked_spans(spark, sf_dir):
    said = frame(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return phrases.linked_spans(said, ["conv_id", "turn"], run_sql(spark, sf_dir, _SURFACES))


# aliases: three to six words out of each benchmark passage, where passages stand in documents also with changes
_ALIASES = """SELECT concat('set', CAST(item_id % 3 AS STRING)) AS label, CAST(item_id AS STRING) AS canonical, array_join(slice(split(text, ' '), 2, CAST(3 + item_id % 4 AS INT)), ' ') AS alias FROM {benchmark}"""


@query(
    "h38_exact_aliases",
    r"""WITH a AS (SELECT DISTINCT concat('set', item_id % 3) AS label, CAST(item_id AS VARCHAR) AS canonical, array_to_string(string_split(text, ' ')[2:4 + item_id % 4], ' ') AS alias FROM benchmark),
 p AS (SELECT *, concat(CASE WHEN regexp_matches(alias, '^[\p{L}\p{N}_]') AND regexp_matches(alias, '[\p{L}\p{N}_]$') THEN '(^|[^\p{L}\p{N}_])' ELSE '()' END, '(', regexp_escape(lower(alias)), ')', CASE WHEN regexp_matches(alias, '^[\p{L}\p{N}_]') AND regexp_matches(alias, '[\p{L}\p{N}_]$') THEN '($|[^\p{L}\p{N}_])' ELSE '()' END) AS pattern FROM a WHERE trim(alias) <> ''),
 h AS (SELECT doc_id, label, canonical, alias, lower(text) AS low, 1 AS one FROM documents JOIN p ON contains(lower(text), lower(alias)))
 SELECT h.doc_id, h.label, h.canonical, count(*) AS hits, min(h.alias) AS alias FROM (SELECT h.*, p.pattern FROM h JOIN p USING (label, canonical, alias)) h, unnest(regexp_extract_all(low, pattern, 2)) AS u(x) GROUP BY h.doc_id, h.label, h.canonical""",
)
def exact_aliases(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    hits = phrases.alias_hits(docs, ["doc_id"], run_sql(spark, sf_dir, _ALIASES), fuzzy_hits=False)
    return hits.groupBy("doc_id", "label", "canonical").agg(F.count("*").alias("hits"), F.min("alias").alias("alias"))


@query("h38_fuzzy_aliases")
def fuzzy_aliases(spark, sf_dir):
    """Exact and similar aliases with offsets; SQL has no such ratio, tests hold it against all windows."""
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    return phrases.alias_hits(docs, ["doc_id"], run_sql(spark, sf_dir, _ALIASES))


_MENTION = r"[A-Z][a-z]{4,}"
_RULES = [("about", r"\b(?:with|avec|mit|con)\b", 0.86), ("of kind", r"\b(?:is an?|est une?|ist eine?|es una?)\b", 0.9), ("about", r"\b(?:for|pour|für|para)\b", 0.8)]
_PATTERNS = [re.compile(_MENTION), *(re.compile(p, re.I) for _, p, _ in _RULES)]


@query(
    "c21_sentence_relations",
    """WITH t AS (SELECT doc_id AS document_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
 s AS (SELECT document_id, text, regexp_split_to_array(text, '[A-Z][a-z]{4,}') AS g, regexp_extract_all(text, '[A-Z][a-z]{4,}') AS m FROM t),
 l AS (SELECT *, list_transform(g, lambda v: length(v)) AS gl, list_transform(m, lambda v: length(v)) AS ml FROM s WHERE len(m) > 0),
 n AS (SELECT document_id, text, CAST(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0) AS INT) AS a, CAST(list_sum(gl[1:i]) + list_sum(ml[1:i]) AS INT) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM l)),
 p AS (SELECT x.document_id, x.text, x.a AS a_start, x.b AS a_stop, y.a AS b_start, y.b AS b_stop FROM n x JOIN n y ON x.document_id = y.document_id AND (x.a, x.b) < (y.a, y.b) AND abs(y.a - x.b) <= 200),
 q AS (SELECT *, CAST(length(regexp_extract(substr(text, 1, a_start), '(?s)^(.*[.!?\\n])', 1)) AS INT) AS evidence_start,
  CAST(b_stop + length(regexp_extract(substr(text, b_stop + 1), '^[^.!?\\n]*')) + 1 AS INT) AS evidence_stop FROM p),
 z AS (SELECT *, substr(text, evidence_start + 1, evidence_stop - evidence_start) AS e FROM q),
 r AS (SELECT *, 'about' AS predicate, 0.86::DOUBLE AS score FROM z WHERE regexp_matches(e, '(^|[^\\p{L}\\p{N}_])(?:with|avec|mit|con)($|[^\\p{L}\\p{N}_])', 'i')
  UNION ALL SELECT *, 'of kind', 0.9 FROM z WHERE regexp_matches(e, '(^|[^\\p{L}\\p{N}_])(?:is an?|est une?|ist eine?|es una?)($|[^\\p{L}\\p{N}_])', 'i')
  UNION ALL SELECT *, 'about', 0.8 FROM z WHERE regexp_matches(e, '(^|[^\\p{L}\\p{N}_])(?:for|pour|für|para)($|[^\\p{L}\\p{N}_])', 'i'))
 SELECT document_id, a_start, a_stop, b_start, b_stop, predicate, max(score) AS score, evidence_start, evidence_stop FROM r GROUP BY ALL""".replace("\\\\", "\\"),
)
def sentence_relations(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = phrases.keyed_rows(docs, ["document_id"], lambda text: intervals.placed_matches(text, _PATTERNS), "pattern int, number int, s_start int, s_stop int, start int, stop int")
    found = found.withColumns({c: F.when(F.col("pattern") == 0, F.col(c)) for c in ("s_start", "s_stop", "start", "stop")})  # a trigger needs its sentence only
    found = Workspace(spark, "relations").save(found, "matches")
    rules = spark.createDataFrame([(i + 1, p, s) for i, (p, _, s) in enumerate(_RULES)], "pattern int, predicate string, score double")
    triggers = found.where("pattern > 0").join(F.broadcast(rules), "pattern")  # a row a rule
    return intervals.rule_relations(found.where("pattern = 0"), triggers)


_GOLD, _FOUND = r"[A-Z][a-z]+ [a-z]{3,}(?: [a-z]{8,})?", r"[A-Z][a-z]{3,}|[a-z]{8,}(?: [a-z]{9,})?"


_GOLD_PATTERN, _FOUND_PATTERN = re.compile(_GOLD), re.compile(_FOUND)


def _mentions(text: str):
    """(label, gold, found): what each side's pattern matches, in lower case; the label from the number of letters of the first word."""
    lists = {"PERSON": ([], []), "ORG": ([], [])}
    for side, pattern in enumerate((_GOLD_PATTERN, _FOUND_PATTERN)):
        for value in set(pattern.findall(text)):
            end = value.find(" ")
            lists["ORG" if (end if end >= 0 else len(value)) % 2 else "PERSON"][side].append(value.lower())
    for label, (gold, found) in lists.items():
        if gold or found:
            yield label, gold, found


@query(
    "d24_relaxed_scores",
    f"""WITH RECURSIVE v AS (SELECT 'g' AS side, doc_id AS document_id, unnest(regexp_extract_all(text, '{_GOLD}')) AS value FROM documents UNION ALL SELECT 'f', doc_id, unnest(regexp_extract_all(text, '{_FOUND}')) FROM documents),
 m AS (SELECT DISTINCT side, document_id, CASE WHEN length(string_split(value, ' ')[1]) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS label, lower(value) AS value FROM v),
 g AS (SELECT document_id, label, value FROM m WHERE side = 'g'), f AS (SELECT document_id, label, value FROM m WHERE side = 'f'),
 b AS (SELECT * FROM g SEMI JOIN f USING (document_id, label, value)),
 rg AS (SELECT * FROM g ANTI JOIN f USING (document_id, label, value)), rf AS (SELECT * FROM f ANTI JOIN g USING (document_id, label, value)),
 e AS (SELECT rg.document_id, rg.label, rg.value AS gold, rf.value AS found FROM rg JOIN rf ON rg.document_id = rf.document_id AND rg.label = rf.label
  WHERE list_has_all(string_split(rg.value, ' '), string_split(rf.value, ' ')) OR list_has_all(string_split(rf.value, ' '), string_split(rg.value, ' '))),
 o AS (SELECT document_id, label, gold, list_sort(list(found)) AS options FROM e GROUP BY ALL),
 h AS (SELECT document_id, label, list(options ORDER BY gold) AS k FROM o GROUP BY ALL),
 w(document_id, label, k, pos, used) AS (SELECT document_id, label, k, 0, CAST([] AS VARCHAR[]) FROM h
  UNION ALL SELECT document_id, label, k, pos + 1, CASE WHEN len(list_filter(k[pos + 1], lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_filter(k[pos + 1], lambda x: NOT list_contains(used, x))[1]) ELSE used END FROM w WHERE pos < len(k)),
 c AS (SELECT label, 1 AS gold, 0 AS found, 0 AS exact, 0 AS paired FROM g UNION ALL SELECT label, 0, 1, 0, 0 FROM f UNION ALL SELECT label, 0, 0, 1, 0 FROM b UNION ALL SELECT label, 0, 0, 0, len(used) FROM w WHERE pos = len(k)),
 s AS (SELECT label, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(found) AS BIGINT) AS found, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(exact) + sum(paired) AS BIGINT) AS relaxed FROM c GROUP BY label
  UNION ALL SELECT '', coalesce(CAST(sum(gold) AS BIGINT), 0), coalesce(CAST(sum(found) AS BIGINT), 0), coalesce(CAST(sum(exact) AS BIGINT), 0), coalesce(CAST(sum(exact) + sum(paired) AS BIGINT), 0) FROM c)
 SELECT label, gold, found, exact, relaxed, {", ".join(f"coalesce({n} / nullif(found, 0)::DOUBLE, 0) AS {n}_precision, coalesce({n} / nullif(gold, 0)::DOUBLE, 0) AS {n}_recall, coalesce(2.0::DOUBLE * {n} / nullif(found + gold, 0), 0) AS {n}_f1" for n in ("exact", "relaxed"))} FROM s""",
)
def relaxed_scores(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    return intervals.mention_scores(phrases.keyed_rows(docs, ["doc_id"], _mentions, "label string, gold array<string>, found array<string>"), ["doc_id"])
