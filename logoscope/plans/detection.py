"""Queries on language detection, sessions and mixed texts."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from logoscope.functions import tables as T
from logoscope.functions import text as X
from logoscope.operators import detect, ngram, packed, segments, session
from logoscope.plans import duck as D
from logoscope.plans.registry import query, table
from logoscope.plans.texts import lines2
from logoscope.sources import markup
from logoscope.sources import utterances as U
from logoscope.sources.scratch import scratch

ENABLED = ["de", "en", "es", "fr", "ru", "he"]

WORD_LIST = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"
GRAMS = "unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))"
MODEL = f"""mw AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest({WORD_LIST}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
 mg AS (SELECT lang, gram, sum(c) AS n FROM (SELECT lang, c, {GRAMS} AS gram FROM mw) GROUP BY ALL),
 mt AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM mg) AS v FROM mg GROUP BY lang),
 model AS (SELECT lang, gram, n::BIGINT AS n, round(ln((n + 1) / (total + v)) * 1000000)::BIGINT AS lp,
   round(ln(1 / (total + v)) * 1000000)::BIGINT AS unseen FROM mg JOIN mt USING (lang))"""


def scored(source: str, key: str) -> str:
    """CTEs from words of a relation (key, text) to ``sc`` (key, lang, score, conf)."""
    return f"""tw AS (SELECT {key}, word, count(*) AS c FROM (SELECT {key}, unnest({WORD_LIST}) AS word FROM {source}) GROUP BY ALL),
 dw AS (SELECT DISTINCT word FROM tw),
 la AS (SELECT lang, min(unseen) AS unseen FROM model GROUP BY lang),
 wsc AS (SELECT word, lang, sum(s) AS score FROM (SELECT word, lang, length(word) * unseen AS s FROM dw, la
   UNION ALL SELECT word, lang, lp - unseen FROM (SELECT word, {GRAMS} AS gram FROM dw) JOIN model USING (gram)) GROUP BY ALL),
 ss AS (SELECT {key}, lang, sum(c * score) AS score FROM tw JOIN wsc USING (word) GROUP BY ALL),
 se AS (SELECT {key}, lang, score, exp((score - max(score) OVER (PARTITION BY {key})) / 1000000) AS e FROM ss),
 sc AS (SELECT {key}, lang, score::BIGINT AS score, e / sum(e) OVER (PARTITION BY {key}) AS conf FROM se)"""


def model_of(spark, sf_dir):
    """The model, trained once for a query and written: scoring reads it for its languages and its grams."""
    path = scratch(spark, "ngram-model")
    ngram.train(table(spark, sf_dir, "documents")).write.parquet(path)
    return spark.read.parquet(path)


@query("ngram_train", f"WITH {MODEL} SELECT lang, gram, n, lp FROM model")
def ngram_train(spark, sf_dir):
    return model_of(spark, sf_dir).select("lang", "gram", "n", "lp")


LINES = D.lines("(SELECT * FROM documents)")


def plain_lines(spark, sf_dir, keep=("source", "lang")):
    return U.lines(table(spark, sf_dir, "documents"), keep=keep)


@query("ngram_score", f"WITH {MODEL}, {scored(LINES, 'doc_id, line_no')} SELECT doc_id, line_no, lang, score, round(conf, 4) AS conf FROM sc")
def ngram_score(spark, sf_dir):
    found = packed.scores(plain_lines(spark, sf_dir), model_of(spark, sf_dir), ["doc_id", "line_no"])
    return found.select("doc_id", "line_no", "lang", "score", F.round("conf", 4).alias("conf"))


TOP = "SELECT {key}, arg_min(lang, (-score, lang)) AS lang, arg_min(conf, (-score, lang)) AS conf FROM sc GROUP BY ALL"


@query("top_language", f"WITH {MODEL}, {scored(LINES, 'doc_id, line_no')}, t AS ({TOP.format(key='doc_id, line_no')}) SELECT doc_id, line_no, lang, round(conf, 4) AS conf FROM t")
def top_language(spark, sf_dir):
    key = ["doc_id", "line_no"]
    return packed.top(plain_lines(spark, sf_dir), model_of(spark, sf_dir), key).withColumn("conf", F.round("conf", 4))


def detected(source: str, key: str, using: str) -> str:
    """CTE ``de`` (key, script_lang, lang, conf, words) of a relation (key, text) that isn't blank."""
    joined = key.split(", ")
    one = f"(SELECT {key}, concat_ws('/', {key}) AS k, text FROM {source})"
    return f"""{MODEL}, dn AS (SELECT {key}, k, {D.natural_words(r"regexp_replace(text, '[^\p{L}\p{Z}]', '', 'g')")} AS nat FROM {one}),
 ds AS (SELECT k, dominant FROM {D.dominant(one, 'k')}),
 dl AS (SELECT {key}, length(nat)::INTEGER AS words, array_to_string(nat, ' ') AS text,
   CASE WHEN l IN ('ipa', 'unicode_braille', {", ".join(D.quoted(x) for x in ENABLED)}) THEN l END AS script_lang
   FROM dn JOIN (SELECT k, {D.case('dominant', T.SCRIPT_LANGUAGES)} AS l FROM ds) USING (k)),
 {scored("(SELECT * FROM dl WHERE script_lang IS NULL AND words > 0)", key)},
 top AS ({TOP.format(key=key)}),
 de AS (SELECT {", ".join("dl." + j for j in joined)}, script_lang, coalesce(script_lang, top.lang) AS lang, top.conf, words FROM dl LEFT JOIN top USING ({key}))"""


@query(
    "detect_language",
    f"WITH {detected(D.lines(D.DOCS2), 'doc_id, line_no', '')} SELECT doc_id, line_no, script_lang, lang, round(conf, 4) AS conf, words FROM de",
)
def detect_language(spark, sf_dir):
    found = detect.detect(lines2(spark, sf_dir), model_of(spark, sf_dir), ["doc_id", "line_no"], ENABLED)
    return found.select("doc_id", "line_no", "script_lang", "lang", F.round("conf", 4).alias("conf"), "words")


@query(
    "lang_distribution",
    f"""WITH {detected(D.lines(D.DOCS2), 'doc_id, line_no', '')} SELECT source, coalesce(de.lang, 'none') AS lang, count(*) AS lines
        FROM de JOIN documents USING (doc_id) GROUP BY ALL""",
)
def lang_distribution(spark, sf_dir):
    """Languages of lines found per source."""
    found = detect.detect(lines2(spark, sf_dir), model_of(spark, sf_dir), ["source", "doc_id", "line_no"], ENABLED)
    return found.groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("lines"))


VOICED = ["en", "de", "ru"]
PAGE_MODE = "CASE page_id % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'markup_only' WHEN 2 THEN 'markup_text' ELSE 'always' END"
PAGE_MIXED = "page_id % 3 <> 1"
#: Pages with nested languages written in; some have no locale of their own.
MARKED = """replace(replace(replace(replace(html, '</h1>', ' <span lang="de-DE">der die und <i lang="ru">мир</i> nicht</span> Привет <i lang="he">да</i></h1>'),
  '<p>The ', '<p lang="fr">The '), '<p>Of ', '<p lang="">Of '), CASE page_id % 5 WHEN 0 THEN '<html lang=' ELSE '' END, CASE page_id % 5 WHEN 0 THEN '<html data-lang=' ELSE '' END)"""
BLOCK = rf"^</?({'|'.join(markup.BLOCKS)})[\s/>]"
CODE = "nullif(lower(regexp_extract(trim({}), '^[^-_.@]*')), '')"
#: HTML's character references: a name is the longest of its table that begins here, with or without a semicolon as the table has it.
NAMED_REFERENCES = ", ".join(f"({D.quoted('&' + k)}, {D.quoted(v)})" for k, v in sorted(html5.items()))
REFERENCE = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&(?:" + "|".join(sorted(html5, key=lambda x: (-len(x), x))) + ")|&|[^&]+"
#: Code points that HTML reads as others, and those that it drops: controls and noncharacters.
MOVED_POINTS = {0x00: 0xFFFD, 0x0D: 0x0D} | {p: ord(bytes([p]).decode("cp1252", "ignore") or chr(p)) for p in range(0x80, 0xA0)}
DROPPED = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534"
POINT = f"""CASE n {" ".join(f"WHEN {a} THEN chr({b})" for a, b in MOVED_POINTS.items())} ELSE CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
 WHEN {DROPPED} THEN '' ELSE chr(n::INTEGER) END END"""
NUMBER = """CASE WHEN regexp_matches(u, '^&#[xX]') THEN coalesce(try_cast('0x' || regexp_extract(u, '[0-9a-fA-F]+', 0, 'i') AS BIGINT), 2000000)
 WHEN starts_with(u, '&#') AND length(u) > 2 THEN coalesce(try_cast(regexp_extract(u, '[0-9]+') AS BIGINT), 2000000) END"""
#: Texts of pages cut by line and by innermost language: an element ends at the first end of its name that balances.
PAGE_PIECES = f"""pt AS (SELECT page_id, m, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT page_id, m, regexp_extract_all(m,
     '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+') AS t FROM (SELECT page_id, {MARKED} AS m FROM pages))),
 pn AS (SELECT page_id, i, w, starts_with(w, '<') AS tag, regexp_extract(w, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1) AS name, starts_with(w, '</') AS ends,
   regexp_matches(w, '{BLOCK}') AND NOT regexp_matches(w, '^<(script|style)') AS block,
   CASE WHEN regexp_matches(w, '^<[a-zA-Z]') AND regexp_matches(w, '\\slang=["'']') THEN regexp_extract(w, '\\slang=["'']([^"'']*)', 1) END AS lang FROM pt),
 po AS (SELECT page_id, i, name, lang FROM pn WHERE lang IS NOT NULL AND name <> 'html'),
 pd AS (SELECT po.page_id, po.i, po.lang, n.i AS j, n.ends, sum(CASE WHEN n.ends THEN -1 ELSE 1 END) OVER (PARTITION BY po.page_id, po.i ORDER BY n.i) AS depth
   FROM po JOIN pn n ON n.page_id = po.page_id AND n.name = po.name AND n.i > po.i),
 pr AS (SELECT po.page_id, po.i AS a, coalesce(min(j) FILTER (WHERE ends AND depth = -1), 1000000000) AS b, po.lang FROM po LEFT JOIN pd USING (page_id, i) GROUP BY ALL),
 er(u, said) AS (VALUES {NAMED_REFERENCES}),
 eu AS (SELECT page_id, i, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM (SELECT page_id, i, regexp_extract_all(w, {D.quoted(REFERENCE)}) AS us FROM pn WHERE NOT tag)),
 en AS (SELECT *, {NUMBER} AS n FROM eu),
 es AS (SELECT page_id, i, replace(string_agg(CASE WHEN n IS NOT NULL THEN {POINT} ELSE coalesce(said, u) END, '' ORDER BY k), chr(10), ' ') AS s FROM en LEFT JOIN er USING (u) GROUP BY ALL),
 ps AS (SELECT page_id, i, block, CASE WHEN block THEN chr(10) WHEN tag THEN '' ELSE s END AS s FROM pn LEFT JOIN es USING (page_id, i)),
 px AS (SELECT page_id, i, block, s, coalesce(sum(length(s)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS spot,
   coalesce(sum(CASE WHEN block THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i), 0)::INTEGER AS line_no FROM ps),
 pl AS (SELECT px.page_id, px.i, s, spot, line_no, {PAGE_MIXED.replace('page_id', 'px.page_id')} AS mixed, arg_max(lang, a) AS lang
   FROM px LEFT JOIN pr ON pr.page_id = px.page_id AND pr.a < px.i AND px.i < pr.b WHERE NOT block AND s <> '' GROUP BY ALL),
 pg AS (SELECT *, CASE WHEN mixed AND lag(lang) OVER w IS DISTINCT FROM lang THEN 1 ELSE 0 END AS new FROM pl WINDOW w AS (PARTITION BY page_id, line_no ORDER BY i)),
 pq AS (SELECT *, sum(new) OVER (PARTITION BY page_id, line_no ORDER BY i) AS g FROM pg),
 pp AS (SELECT page_id, line_no, min(spot) AS start, string_agg(s, '' ORDER BY i) AS text, CASE WHEN mixed THEN any_value(lang) END AS tag, mixed FROM pq
   GROUP BY page_id, line_no, g, mixed HAVING regexp_matches(string_agg(s, '' ORDER BY i), '[^{D.S}]')),
 lo AS (SELECT page_id, nullif(regexp_extract({MARKED}, '<html[^>]*\\slang="([^"]*)"', 1), '') AS locale FROM pages)"""


def marked_pieces(spark, sf_dir):
    """(page_id, locale, mixed, line_no, start, tag, text): lines of pages, those of mixed ones cut where the declared language changes."""
    path = scratch(spark, "pages")
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(MARKED).alias("html"))
    scan = pages.select("page_id", F.expr(PAGE_MIXED).alias("mixed"), markup.scanned(F.col("html")).alias("s"))
    scan.select("page_id", "mixed", "s.*").write.parquet(path)
    scan = spark.read.parquet(path)
    lines = scan.select("page_id", "mixed", "locale", F.inline("lines"))
    kept = ["page_id", "line_no", "start"]
    whole = lines.where(~F.col("mixed") & ~X.is_blank(F.col("text"))).select(*kept, F.lit(None).cast("string").alias("tag"), "text")
    cut = markup.pieces(lines.where("mixed"), scan.where("mixed").select("page_id", F.inline("ranges")), ["page_id"])
    return whole.union(cut.select(*kept, F.col("lang").alias("tag"), "text")).join(scan.select("page_id", "mixed", "locale"), "page_id")


@query(
    "resolve_language",
    f"""WITH {PAGE_PIECES}, {detected('pp', 'page_id, line_no, start', '')},
        h AS (SELECT *, {PAGE_MODE} AS mode, {CODE.format("CASE WHEN mixed THEN tag END")} AS range_lang, {CODE.format("locale")} AS locale_lang
              FROM pp JOIN de USING (page_id, line_no, start) JOIN lo USING (page_id)),
        r AS (SELECT *, CASE mode WHEN 'off' THEN NULL WHEN 'always' THEN lang WHEN 'markup_text' THEN coalesce(range_lang, locale_lang, lang)
          ELSE coalesce(range_lang, locale_lang, script_lang, 'en') END AS resolved FROM h),
        v AS (SELECT *, CASE WHEN resolved IN ('en', 'de', 'ru') THEN resolved END AS voice FROM r),
        u AS (SELECT *, CASE WHEN NOT mixed AND voice IS NOT NULL THEN voice WHEN mode = 'markup_only' THEN coalesce(voice, script_lang, 'en') ELSE lang END AS found FROM v)
        SELECT page_id, line_no, start, mode, mixed, CASE WHEN mode = 'off' THEN 'off' WHEN mode <> 'always' AND range_lang IS NOT NULL THEN 'range'
            WHEN mode <> 'always' AND locale_lang IS NOT NULL THEN 'locale' WHEN mode = 'markup_only' AND script_lang IS NULL THEN 'default' ELSE 'detection' END AS won,
          resolved, voice, CASE WHEN mode <> 'off' THEN coalesce(CASE WHEN found IN ('en', 'de', 'ru') THEN found END, voice) END AS utterance FROM u""",
)
def resolve_language(spark, sf_dir):
    """Languages of lines of pages and of the utterances made of them: markup of ranges, locale of the page, detection, default."""
    rows = marked_pieces(spark, sf_dir).withColumn("mode", F.expr(PAGE_MODE))
    key = ["page_id", "line_no", "start", "mode", "mixed", "tag", "locale"]
    found = detect.detect(rows, model_of(spark, sf_dir), key, ENABLED)
    mode, mixed, script, default = F.col("mode"), F.col("mixed"), F.col("script_lang"), F.lit("en")
    voiced = F.array(*[F.lit(v) for v in VOICED])
    resolved = detect.resolve(mode, mixed, F.col("tag"), F.col("locale"), script, F.col("lang"), default)
    won = (
        F.when(mode == "off", "off").when((mode != "always") & mixed & X.lang_code(F.col("tag")).isNotNull(), "range")
        .when((mode != "always") & X.lang_code(F.col("locale")).isNotNull(), "locale").when((mode == "markup_only") & script.isNull(), "default").otherwise("detection")
    )
    found = found.withColumn("won", won).withColumn("resolved", resolved)
    found = found.withColumn("voice", F.when(F.array_contains(voiced, F.col("resolved")), F.col("resolved")))
    utterance = detect.resolve_utterance(mode, mixed, F.col("voice"), script, F.col("lang"), default, voiced)
    return found.select("page_id", "line_no", "start", "mode", "mixed", "won", "resolved", "voice", utterance.alias("utterance"))


#: Turns of conversations, some with words of other languages and short ones, so that the state machine has work.
TURN_TEXT = """CASE (conv_id + turn) % 9 WHEN 1 THEN 'der die und nicht' WHEN 2 THEN 'und' WHEN 4 THEN 'Привет мир' WHEN 5 THEN 'les des que'
 WHEN 6 THEN ' ' WHEN 7 THEN '⠓⠑⠇⠇⠕' ELSE text END"""


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(TURN_TEXT).alias("text"))


def turn_detections(spark, sf_dir):
    """All turns with what is detected in them, in the shape of the state machine."""
    rows = turns(spark, sf_dir)
    found = detect.detect(rows, model_of(spark, sf_dir), ["conv_id", "turn"], ENABLED)
    joined = rows.drop("text").join(found, ["conv_id", "turn"], "left")
    return joined.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "script_lang", "lang", "conf", "words", F.lit(None).cast("string").alias("hint"))


TURNS = f"(SELECT conv_id, turn, {TURN_TEXT} AS text FROM conversations)"
SESSIONS = f"""WITH RECURSIVE {detected(f"(SELECT * FROM {TURNS} WHERE regexp_matches(text, '[^{D.S}]'))", 'conv_id, turn', '')},
 o AS (SELECT conv_id, turn, script_lang, lang AS d, coalesce(conf, 0) AS c, coalesce(words, 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
   FROM {TURNS} LEFT JOIN de USING (conv_id, turn)),
 f AS (SELECT conv_id, 0::BIGINT AS rn, NULL::BIGINT AS turn, 'en' AS cur, '' AS h, NULL::VARCHAR AS spoken FROM (SELECT DISTINCT conv_id FROM o)
   UNION ALL
   SELECT conv_id, rn, turn, CASE WHEN act = 'become' THEN d ELSE cur END,
     CASE WHEN act IN ('become') THEN '' WHEN act = 'hear' THEN d ELSE h END,
     CASE WHEN act = 'sentinel' THEN d WHEN act = 'become' THEN d ELSE cur END
   FROM (SELECT o.conv_id, o.rn, o.turn, o.d, f.cur, f.h, CASE
       WHEN o.script_lang IN ('ipa', 'unicode_braille') THEN 'sentinel' WHEN o.script_lang IS NOT NULL THEN 'become'
       WHEN o.d IS NULL THEN 'stay' WHEN o.d = f.cur THEN 'become'
       WHEN f.cur = 'en' AND o.c < 0.92 THEN 'stay'
       WHEN (f.cur <> 'en' OR o.n >= 3) AND o.n >= 2 THEN 'become'
       WHEN f.h = o.d THEN 'become' ELSE 'hear' END AS act
     FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1))"""


@query("session_language", SESSIONS + " SELECT conv_id AS session, turn AS seq, spoken FROM f WHERE rn > 0")
def session_language(spark, sf_dir):
    return session.session_language(turn_detections(spark, sf_dir))


@query(
    "session_language_scripts",
    f"""WITH t AS (SELECT concat_ws('/', conv_id, turn) AS k, * FROM {TURNS})
        SELECT conv_id AS session, turn AS seq, CASE WHEN l IN ('ipa', 'unicode_braille', {", ".join(D.quoted(x) for x in ENABLED)}) THEN l END AS spoken
        FROM t JOIN (SELECT k, {D.case('dominant', T.SCRIPT_LANGUAGES)} AS l FROM {D.dominant('t', 'k')}) USING (k)""",
)
def session_language_scripts(spark, sf_dir):
    """Detection by script alone that doesn't fall back to the current language: null without a signal."""
    return session.session_language(turn_detections(spark, sf_dir), statistical=False, fallback=False)


#: Effective changes: each turn has the last language with a voice so far.
EVENTS = """ SELECT session, seq, before, lang FROM (SELECT *, coalesce(lag(lang) OVER (PARTITION BY session ORDER BY seq), 'en') AS before FROM (
  SELECT conv_id AS session, turn AS seq, coalesce(last_value(CASE WHEN spoken IN ('en', 'de', 'ru') THEN spoken END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn), 'en') AS lang FROM f WHERE rn > 0)) WHERE lang <> before"""


@query("switch_events", SESSIONS + EVENTS)
def switch_events(spark, sf_dir):
    return segments.switch_events(session.session_language(turn_detections(spark, sf_dir)), "session", "seq", "spoken", "en", VOICED)


#: Lines with a clause in another language written in.
MIXED = """text || CASE doc_id % 3 WHEN 0 THEN ' der die und nicht mit sich auf das ist ein' WHEN 1 THEN ' les des que dans pour sur une est par pas' ELSE '' END"""
MIXED_LINES = D.lines(f"(SELECT doc_id, source, lang, {MIXED} AS text FROM documents)")
PIECES = f"""ln AS (SELECT doc_id, line_no, text, length({D.words('text')}) AS n FROM {MIXED_LINES}),
 pa AS (SELECT doc_id, line_no, n, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM (SELECT *, CASE WHEN n <= 30 THEN [text]
   ELSE regexp_split_to_array(regexp_replace(text, '([.!?])[{D.S}]+', '\\1' || chr(1), 'g'), '\\x{{1}}|\\n+') END AS parts FROM ln WHERE n BETWEEN 8 AND 600)),
 pw AS (SELECT doc_id, line_no, n, p, {D.words('part')} AS w FROM pa),
 pk AS (SELECT *, unnest(range(0, length(w), 40)) AS k FROM pw),
 pc AS (SELECT doc_id, line_no, n, p, k, w[k + 1:k + 40] AS t FROM pk),
 tk AS (SELECT doc_id, line_no, p, k, short, token, pos, regexp_replace(lower(token), '[^\\p{{L}}]', '', 'g') AS word FROM (
   SELECT doc_id, line_no, p, k, n > 30 AND length(t) < 8 AS short, unnest(t) AS token, generate_subscripts(t, 1) AS pos
   FROM pc WHERE regexp_matches(array_to_string(t, ' '), '\\p{{L}}')))"""
SEGMENTS = f"""WITH {MODEL}, {PIECES}, dw AS (SELECT DISTINCT word FROM tk WHERE word <> ''),
 la AS (SELECT lang, min(unseen) AS unseen FROM model GROUP BY lang),
 wsc AS (SELECT word, lang, sum(s) AS score FROM (SELECT word, lang, length(word) * unseen AS s FROM dw, la
   UNION ALL SELECT word, lang, lp - unseen FROM (SELECT word, {GRAMS} AS gram FROM dw) JOIN model USING (gram)) GROUP BY ALL),
 full_ AS (SELECT doc_id, line_no, p, k, short, pos, token, la.lang, coalesce(score, 0) AS score FROM tk CROSS JOIN la LEFT JOIN wsc ON wsc.word = tk.word AND wsc.lang = la.lang),
 sm AS (SELECT *, CASE WHEN short THEN sum(score) OVER (PARTITION BY doc_id, line_no, p, k, lang)
   ELSE sum(score) OVER (PARTITION BY doc_id, line_no, p, k, lang ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s FROM full_),
 be AS (SELECT doc_id, line_no, p, k, pos, token, arg_min(lang, (-s, lang)) AS lang FROM sm GROUP BY ALL),
 ch AS (SELECT *, CASE WHEN lag(lang) OVER w IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS c FROM be WINDOW w AS (PARTITION BY doc_id, line_no, p, k ORDER BY pos)),
 ru AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, line_no ORDER BY p, k, pos) - 1 AS seg FROM ch),
 sg AS (SELECT doc_id, line_no, seg::INTEGER AS seg, lang, string_agg(token, ' ' ORDER BY pos) AS text FROM ru GROUP BY ALL),
 fin AS (SELECT * FROM sg WHERE (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM sg GROUP BY doc_id, line_no HAVING count(DISTINCT lang) > 1))"""


def mixed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(MIXED).alias("text"))
    return segments.mixed_texts(U.lines(docs), model_of(spark, sf_dir), ["doc_id", "line_no"])


@query("mixed_segments", SEGMENTS + " SELECT doc_id, line_no, seg, lang, text FROM fin")
def mixed_segments(spark, sf_dir):
    return segments.listed(mixed_texts(spark, sf_dir), ["doc_id", "line_no"])


@query("switch_pause", SEGMENTS + """ SELECT doc_id, line_no, seg, lang, CASE WHEN lag(lang) OVER (PARTITION BY doc_id, line_no ORDER BY seg) <> lang THEN 0.3 ELSE 0.0 END::DOUBLE AS pause FROM fin""")
def switch_pause(spark, sf_dir):
    found = mixed_texts(spark, sf_dir).withColumn("segments", segments.with_pauses(F.col("segments")))
    return segments.listed(found, ["doc_id", "line_no"], ("seg", "lang", "pause"))


@query("segment_languages", SEGMENTS + " SELECT doc_id, line_no, count(*) AS segments, count(DISTINCT lang) AS languages FROM fin GROUP BY ALL")
def segment_languages(spark, sf_dir):
    parts = F.col("segments")
    return mixed_texts(spark, sf_dir).select(
        "doc_id", "line_no", F.size(parts).cast("long").alias("segments"), F.size(F.array_distinct(parts.getField("lang"))).cast("long").alias("languages")
    )


@query("concat_segments", SEGMENTS + " SELECT doc_id, string_agg(lang || ':' || text, '|' ORDER BY line_no, seg) AS said FROM fin GROUP BY doc_id")
def concat_segments(spark, sf_dir):
    """Segments of all lines of a document, in order."""
    line = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["lang"], s["text"])), "|")
    lines = F.array_sort(F.collect_list(F.struct("line_no", line.alias("t"))))
    return mixed_texts(spark, sf_dir).groupBy("doc_id").agg(F.array_join(lines.getField("t"), "|").alias("said"))


