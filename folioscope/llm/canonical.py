"""p1: mapping freely typed labels to the entries of a reference list, in SQL alone.

Labels and reference strings get the same spelling key (case, accents, look-alike digits, list marks, word order around
"of" and commas, plural endings, cut-off words). Keys within k edits are found by a partition-based pigeonhole join: a
reference key is cut into k + 1 segments, of which a key within k edits has at least one unchanged and hardly moved, so
an equality join on (length, segment, substring) finds every such pair; the built-in levenshtein verifies it. Left over
are near misses that are other words ("erosion", "invasion"); word by word, a pair must be within a third of the word,
and a word that the reference list itself spells out is no misspelling of another.

Defined results: null, empty and filler labels name nothing; a label that names two entries equally well names neither;
a concept is mapped to the one entry that its labels name most closely, and not at all if two entries tie; abbreviations
in capitals count where no written-out label of the concept names another thing. Repeated rows and labels count once;
extra columns are not read; an empty table gives an empty result. Very long labels cannot be within k edits of a
reference key of a third of their length and are reported as unmatched. Keys of up to three letters are found only if spelled alike.
A label that fails inside a mapped concept is reported with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import ACCENTED, PLAIN
from folioscope.plans.session import cut

#: Edits that a key may be away, by its length: a misprint or two a word, none in a few letters.
K = "CASE WHEN length(key) < 4 THEN 0 WHEN length(key) < 9 THEN 1 WHEN length(key) < 13 THEN 2 WHEN length(key) < 18 THEN 3 WHEN length(key) < 24 THEN 4 ELSE 5 END"
#: Entries of the reference list up to which its segments are sent to every executor; a longer list is shuffled.
BROADCAST_ENTRIES = 50_000
#: Abbreviations that are no beginnings of the word.
SHORT_FORMS = {"mgmt": "management", "mgt": "management", "fw": "freshwater", "govce": "governance", "prog": "programme", "progr": "programme"}

SPELLED = f"""
SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(
    lower(regexp_replace(translate(label, '{ACCENTED}', '{PLAIN}'), '\\\\p{{M}}', '')),
    '[\\\\p{{Z}}\\\\s]+', ' '),
    '\\\\[[^\\\\]]*\\\\]|\\\\([^)]*\\\\)|@[a-z]{{2}}\\\\b|\\\\betc\\\\b|\\\\bterm:|^[^a-z0-9]*[0-9]+([.][0-9]+)*[.)]?(?= )|\\\\bch[.] ?[0-9.]+', ' '),
    '[^a-z0-9,]+', ' ')) AS words
FROM {{labels}}
"""

#: Word order: the part after a comma goes first, and so does the part after "of".
ORDERED = """
SELECT DISTINCT label, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(words,
    '^[ ,]+|[ ,]+$', ''),
    '^(?:use of |the )+', ''),
    '^([^,]+?) ?, ?([^,]+)$', '$2 $1'),
    '^(.+?) of (?:the )?(.+)$', '$2 $1'),
    ' *, *', ' ')) AS phrase
FROM {spelled}
"""

TOKENS = """
SELECT label, pos, token FROM (SELECT label, posexplode(split(regexp_replace(phrase, '\\\\btrans bound\\\\b', 'transboundary'), ' ')) AS (pos, token) FROM {ordered}) WHERE token <> ''
"""

#: A word's own key: digits that look like letters, then one letter for the three that look alike, then no plural ending.
WORD_KEY = """
translate(regexp_replace(regexp_replace(CASE WHEN {token} RLIKE '[a-z]' THEN translate({token}, '01', 'ol') ELSE {token} END, '(?<=[a-z]{{2}})ies$', 'y'), '(?<=[a-z]{{3}}[a-rt-z])s$', ''), 'il', 'll')
"""

#: Words of the reference list (without its misspelt hidden labels) and the beginnings that only one of them has.
CUT_OFF = """
SELECT cut, min(word) AS word FROM (SELECT word, substring(word, 1, n) AS cut FROM (SELECT word, explode(sequence(3, greatest(3, length(word) - 1))) AS n FROM {vocabulary}) WHERE n < length(word))
GROUP BY cut HAVING count(DISTINCT word) = 1
"""

SEGMENTS = f"""
SELECT ref_key, length(ref_key) AS len, k, i, 1 + i * (length(ref_key) DIV (k + 1)) + greatest(0, i - (k + 1 - length(ref_key) % (k + 1))) AS at,
    length(ref_key) DIV (k + 1) + CASE WHEN i >= k + 1 - length(ref_key) % (k + 1) THEN 1 ELSE 0 END AS width
FROM (SELECT key AS ref_key, {K} AS k FROM {{keys}}) LATERAL VIEW explode(sequence(0, k)) s AS i
"""

#: Substrings of a key that an unchanged segment i of a key of another length can be: the shift is at most i to either side of the start and k - i of the end.
#: The segments' places are listed for each length of key that they can meet, so that keys meet them by equality.
PROBES = """
SELECT q.key, l.len, l.i, substring(q.key, p, l.width) AS piece
FROM (SELECT key, length(key) AS n FROM {queries}) q JOIN (SELECT DISTINCT len, k, i, at, width, n FROM {segments} LATERAL VIEW explode(sequence(len - k, len + k)) e AS n) l ON q.n = l.n
LATERAL VIEW explode(sequence(greatest(1, l.at - l.i, l.at + q.n - l.len - (l.k - l.i)), least(q.n - l.width + 1, l.at + l.i, l.at + q.n - l.len + (l.k - l.i)))) s AS p
WHERE greatest(1, l.at - l.i, l.at + q.n - l.len - (l.k - l.i)) <= least(q.n - l.width + 1, l.at + l.i, l.at + q.n - l.len + (l.k - l.i))
"""

PAIRS = """
SELECT DISTINCT p.key, s.ref_key, s.k
FROM {probes} p JOIN (SELECT ref_key, len, i, k, substring(ref_key, at, width) AS piece FROM {segments}) s ON p.len = s.len AND p.i = s.i AND p.piece = s.piece
"""

VERIFIED = """
SELECT key, ref_key, levenshtein(key, ref_key, k) AS edits FROM {pairs} WHERE levenshtein(key, ref_key, k) >= 0
"""

BEST = """
SELECT label, min(canon_id) AS canon_id, min(edits) AS edits FROM (SELECT *, min(edits) OVER (PARTITION BY label) AS least FROM {plausible}) WHERE edits = least
GROUP BY label HAVING count(DISTINCT canon_id) = 1
"""


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """spark.sql with frames put in for their {names}; other braces are the regular expressions'."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **frames)


def _keys(spark: SparkSession, labels: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(label, tokens, known, key) of distinct labels; with a vocabulary, cut-off words are completed first."""
    spelled = _sql(spark, SPELLED, labels=labels)
    tokens = _sql(spark, TOKENS, ordered=_sql(spark, ORDERED, spelled=spelled))
    if vocabulary is None:
        return _sql(spark, f"SELECT label, pos, {WORD_KEY.format(token='token')} AS word FROM {{tokens}}", tokens=tokens)
    short = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT_FORMS.items())
    cut_off = _sql(spark, CUT_OFF, vocabulary=vocabulary)
    words = _sql(spark, f"SELECT label, pos, {WORD_KEY.format(token=f'(CASE token {short} ELSE token END)')} AS word FROM {{tokens}}", tokens=tokens)
    return _sql(
        spark,
        "SELECT w.label, w.pos, CASE WHEN v.word IS NULL AND c.word IS NOT NULL THEN c.word ELSE w.word END AS word, v.word IS NOT NULL OR c.word IS NOT NULL AS known"
        " FROM {words} w LEFT JOIN {vocabulary} v ON v.word = w.word LEFT JOIN {cut_off} c ON c.cut = w.word",
        words=words, vocabulary=vocabulary, cut_off=cut_off,
    )


def map_labels(spark: SparkSession, labels: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(label, canon_id, edits) of the distinct labels that name an entry; edits is -1 for an abbreviation in capitals.

    thesaurus is the reference list, whose size is that of the list and not of the data.
    """
    return named(spark, *plausible_entries(spark, labels, thesaurus))


def plausible_entries(spark: SparkSession, labels: DataFrame, thesaurus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, canon_id, edits) of all entries near a label, and of those that its capitals stand for."""
    listed = _sql(
        spark,
        "SELECT DISTINCT canon_id, label, hidden FROM (SELECT canon_id, pref_label AS label, false AS hidden FROM {t} UNION ALL SELECT canon_id, explode(alt_labels), false FROM {t} UNION ALL SELECT canon_id, explode(hidden_labels), true FROM {t})"
        " WHERE label IS NOT NULL AND trim(label) <> ''",
        t=thesaurus,
    )
    capitals = "regexp_extract(label, '^[^\\\\p{L}]*(?i:term:\\\\s*|use of\\\\s+)?[^\\\\p{L}]*(\\\\p{Lu}\\\\p{L}{1,7})(?:[^\\\\p{L}]*|[^\\\\p{L}].*(?i:term:|@en|draft|etc|pl)[^\\\\p{L}]*)$', 1)"
    ref_words = _keys(spark, _sql(spark, "SELECT DISTINCT label FROM {l} WHERE NOT label RLIKE '^\\\\p{Lu}+$'", l=listed), None)
    ref_words = cut(ref_words)
    vocabulary = _sql(spark, "SELECT DISTINCT word FROM {w} JOIN (SELECT DISTINCT label FROM {l} WHERE NOT hidden) USING (label) WHERE length(word) > 2", w=ref_words, l=listed)
    vocabulary = cut(vocabulary)
    by_label = "SELECT label, transform(array_sort(collect_list(struct(pos, word))), x -> x.word) AS tokens, array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), '') AS key FROM {w} GROUP BY label"
    reference = _sql(spark, "SELECT l.canon_id, k.tokens, k.key FROM {l} l JOIN {k} k USING (label)", l=listed, k=_sql(spark, by_label, w=ref_words))
    reference = cut(reference)
    own = _sql(spark, "SELECT DISTINCT label FROM {l} WHERE label IS NOT NULL", l=labels)
    words = _keys(spark, own, vocabulary)
    label_keys = _sql(
        spark,
        "SELECT label, transform(x, y -> y.word) AS tokens, transform(x, y -> y.known) AS known, array_join(transform(x, y -> y.word), '') AS key FROM (SELECT label, array_sort(collect_list(struct(pos, word, known))) AS x FROM {w} GROUP BY label)",
        w=words,
    )
    label_keys = cut(_sql(spark, "SELECT * FROM {k} WHERE key <> ''", k=label_keys))
    segments = cut(_sql(spark, SEGMENTS, keys=_sql(spark, "SELECT DISTINCT key FROM {r} WHERE key <> ''", r=reference)))
    if thesaurus.count() <= BROADCAST_ENTRIES:
        segments = F.broadcast(segments)
    # Keys that the list spells alike need no search.
    own_keys, ref_keys = _sql(spark, "SELECT DISTINCT key FROM {k}", k=label_keys), _sql(spark, "SELECT DISTINCT key FROM {r}", r=reference)
    exact = _sql(spark, "SELECT q.key, r.key AS ref_key, 0 AS edits FROM {q} q JOIN {r} r ON r.key = q.key", q=own_keys, r=ref_keys)
    probes = _sql(spark, PROBES, queries=_sql(spark, "SELECT q.key FROM {q} q LEFT ANTI JOIN {r} r ON r.key = q.key", q=own_keys, r=ref_keys), segments=segments)
    verified = cut(_sql(spark, "SELECT * FROM {e} UNION ALL SELECT * FROM {v}", e=exact, v=_sql(spark, VERIFIED, pairs=_sql(spark, PAIRS, probes=probes, segments=segments))))
    plausible = cut(_plausible(spark, verified, label_keys, reference))
    abbreviations = _sql(spark, "SELECT label AS short, min(canon_id) AS canon_id FROM {l} WHERE label RLIKE '^\\\\p{Lu}{2,8}$' GROUP BY label HAVING count(DISTINCT canon_id) = 1", l=listed)
    in_capitals = _sql(spark, f"SELECT o.label, a.canon_id, -1 AS edits FROM (SELECT label, {capitals} AS short FROM {{o}}) o JOIN {{a}} a ON a.short = upper(o.short)", o=own, a=abbreviations)
    return plausible, in_capitals


def named(spark: SparkSession, plausible: DataFrame, in_capitals: DataFrame) -> DataFrame:
    """The one nearest entry of each label, else the one that its capitals stand for."""
    best = _sql(spark, BEST, plausible=plausible)
    return _sql(spark, "SELECT label, canon_id, edits FROM {b} UNION ALL SELECT c.* FROM {c} c LEFT ANTI JOIN {b} b2 ON b2.label = c.label", b=best, b2=best, c=in_capitals)


def _plausible(spark: SparkSession, verified: DataFrame, label_keys: DataFrame, reference: DataFrame) -> DataFrame:
    """Word by word where both have as many words; words run together may have fewer edits."""
    joined = _sql(
        spark,
        "SELECT l.label, r.canon_id, v.edits, v.ref_key, l.tokens AS lt, l.known, r.tokens AS rt FROM {v} v JOIN {l} l ON l.key = v.key JOIN {r} r ON r.key = v.ref_key",
        v=verified, l=label_keys, r=reference,
    )
    return _sql(
        spark,
        "SELECT label, canon_id, min(edits) AS edits FROM {j} WHERE edits = 0 OR CASE WHEN size(lt) = size(rt)"
        " THEN forall(sequence(0, size(lt) - 1), i -> lt[i] = rt[i] OR (NOT known[i] AND levenshtein(lt[i], rt[i]) <= greatest(1, length(rt[i]) DIV 3)))"
        " ELSE edits <= length(ref_key) DIV 8 AND NOT forall(known, y -> y) END GROUP BY label, canon_id",
        j=joined,
    )


#: A concept's labels, its real ones being those that are no fillers.
CONCEPT_LABELS = """
SELECT DISTINCT concept_id, label FROM (SELECT concept_id, pref_label AS label FROM {c} UNION ALL SELECT concept_id, explode(alt_labels) FROM {c} UNION ALL SELECT concept_id, explode(hidden_labels) FROM {c})
WHERE label IS NOT NULL
"""

FOUND = """
SELECT concept_id, canon_id FROM (
    SELECT concept_id, canon_id, votes, edits, rank() OVER (PARTITION BY concept_id ORDER BY votes DESC, edits) AS place, count(*) OVER (PARTITION BY concept_id, votes, edits) AS ties
    FROM (SELECT l.concept_id, m.canon_id, count_if(m.edits >= 0) AS votes, min(m.edits) AS edits FROM {l} l JOIN {m} m ON m.label = l.label GROUP BY l.concept_id, m.canon_id))
WHERE place = 1 AND ties = 1
"""


#: Labels of concepts that came to no entry, and why: nothing written, no entry near, several entries equally near, or another entry than the concept's.
UNMATCHED = """
SELECT l.concept_id, l.label, CASE WHEN NOT l.label RLIKE '[\\\\p{L}\\\\p{N}]' THEN 'blank' WHEN n.label IS NULL THEN 'none near' WHEN m.label IS NULL THEN 'several near' WHEN f.concept_id IS NULL THEN 'labels disagree' ELSE 'another entry' END AS reason
FROM {l} l LEFT JOIN (SELECT DISTINCT label FROM {near}) n ON n.label = l.label LEFT JOIN {m} m ON m.label = l.label LEFT JOIN {f} f ON f.concept_id = l.concept_id
WHERE m.label IS NULL OR f.concept_id IS NULL OR f.canon_id <> m.canon_id
"""


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    concepts = spark.read.parquet(f"{sf}/concepts.parquet").select("concept_id", "pref_label", "alt_labels", "hidden_labels")
    return cut(_sql(spark, CONCEPT_LABELS, c=concepts)), spark.read.parquet(f"{sf}/thesaurus.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    labels, thesaurus = _labels(spark, sf)
    return _sql(spark, FOUND, l=labels, m=map_labels(spark, labels, thesaurus)).distinct()


def unmatched(spark: SparkSession, labels: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(concept_id, label, reason) of the labels (concept_id, label) that come to no entry or not to their concept's."""
    near = plausible_entries(spark, labels, thesaurus)
    mapped = cut(named(spark, *near))
    return _sql(spark, UNMATCHED, l=labels, near=near[0], m=mapped, f=_sql(spark, FOUND, l=labels, m=mapped))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched(spark, *_labels(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
ORACLES: dict[str, str] = {}
