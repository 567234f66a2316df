"""Queries on sources, scalar functions, filters and counts over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logoscope.functions import chars, rewrite, scripts
from logoscope.functions import tables as T
from logoscope.functions import text as X
from logoscope.plans import duck as D
from logoscope.plans.registry import query, table
from logoscope.sources import utterances as U


def docs2(spark, sf_dir):
    """All documents, with symbols and scripts written in."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(U.INJECTED).alias("text"))


def lines2(spark, sf_dir):
    return U.lines(docs2(spark, sf_dir), keep=("source", "lang"))


def distinct_chars(spark, sf_dir):
    """(ch, n) of all texts: counted first, so that character functions run once a character."""
    return docs2(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


@query("utterances_from_documents", f"SELECT doc_id, line_no, text FROM {D.lines('(SELECT * FROM documents)')}")
def utterances_from_documents(spark, sf_dir):
    return U.lines(table(spark, sf_dir, "documents"))


@query(
    "utterances_from_list",
    f"""SELECT doc_id, string_agg({D.expand_emojis('line')}, chr(10) ORDER BY i) AS elements FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {D.DOCS2}) GROUP BY doc_id""",
)
def utterances_from_list(spark, sf_dir):
    rows = docs2(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("elements"))
    rewritten = F.transform("elements", lambda x: F.when(x != "", rewrite.expand_emojis(x)).otherwise(x))
    return rows.select("doc_id", F.array_join(rewritten, "\n").alias("elements"))


TAGGED = """CASE doc_id % 7 WHEN 0 THEN upper(lang) || '-DE' WHEN 1 THEN lang || '_DE.UTF-8' WHEN 2 THEN lang || '@variant'
 WHEN 3 THEN ' ' || lang || '-Latn-US ' WHEN 4 THEN '' WHEN 5 THEN lang || '_AT-x' ELSE lang END"""


@query(
    "normalize_lang_tag",
    f"SELECT doc_id, nullif(lower(regexp_extract(trim({TAGGED}), '^[^-_.@]*')), '') AS code FROM documents",
)
def normalize_lang_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.lang_code(F.expr(TAGGED)).alias("code"))


@query(
    "voice_dialect",
    f"""SELECT doc_id, CASE WHEN contains(tag, '-') THEN substr(tag, strpos(tag, '-') + 1) WHEN contains(tag, '_') THEN substr(tag, strpos(tag, '_') + 1) ELSE '' END AS dialect,
        coalesce(string_split(replace(tag, '_', '-'), '-')[2], '') AS variant FROM (SELECT doc_id, {TAGGED} AS tag FROM documents)""",
)
def voice_dialect(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(TAGGED).alias("tag"))
    return rows.select("doc_id", X.dialect(F.col("tag")).alias("dialect"), X.second_subtag(F.col("tag")).alias("variant"))


@query("char_script", f"SELECT ch, n, {D.script_of('ch')} AS script FROM {D.CHARS}")
def char_script(spark, sf_dir):
    return distinct_chars(spark, sf_dir).select("ch", "n", scripts.char_script(F.col("ch")).alias("script"))


@query("clean_letters", rf"SELECT doc_id, line_no, regexp_replace(text, '[^\p{{L}}\p{{Z}}]', '', 'g') AS letters FROM {D.lines(D.DOCS2)}")
def clean_letters(spark, sf_dir):
    return lines2(spark, sf_dir).select("doc_id", "line_no", X.clean_letters(F.col("text")).alias("letters"))


@query("natural_words", f"SELECT doc_id, line_no, array_to_string({D.natural_words('text')}, ' ') AS words FROM {D.lines(D.DOCS2)}")
def natural_words(spark, sf_dir):
    return lines2(spark, sf_dir).select("doc_id", "line_no", F.array_join(X.natural_words(F.col("text")), " ").alias("words"))


@query(
    "noise_token",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest({D.words('text')}) AS token FROM {D.DOCS2})
        WHERE regexp_matches(token, {D.quoted(X.NOISE)}) GROUP BY token""",
)
def noise_token(spark, sf_dir):
    tokens = docs2(spark, sf_dir).select(F.explode(X.words(F.col("text"))).alias("token"))
    return tokens.where(X.is_noise(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query("is_invisible", f"SELECT ch, n, coalesce(unicode(ch) IN (8205, 65039) OR unicode(ch) BETWEEN 127462 AND 127487, false) AS invisible FROM {D.CHARS}")
def is_invisible(spark, sf_dir):
    return distinct_chars(spark, sf_dir).select("ch", "n", X.is_invisible(F.col("ch")).alias("invisible"))


ODD = "".join(D.BRIEF) + "👨👩👧😀"


@query("is_pronounceable", f"SELECT ch, n, NOT contains('{ODD}', ch) AS pronounceable FROM {D.CHARS}")
def is_pronounceable(spark, sf_dir):
    return distinct_chars(spark, sf_dir).select("ch", "n", X.is_pronounceable(F.col("ch")).alias("pronounceable"))


SAID = D.BRIEF | {"👨": "man", "👩": "woman", "👧": "girl", "😀": "grinning face"}
VERBOSE = SAID | {"─": "light horizontal", "‍": "zero width joiner"}


@query("char_spoken_name", f"SELECT ch, n, {D.case('ch', SAID)} AS brief_name, {D.case('ch', VERBOSE)} AS verbose_name FROM {D.CHARS}")
def char_spoken_name(spark, sf_dir):
    """The dimension joined to the characters that occur; both sides are bounded by Unicode."""
    names = chars.char_dimension(spark).select("ch", "brief", "verbose")
    return distinct_chars(spark, sf_dir).join(F.broadcast(names), "ch", "left").select("ch", "n", F.col("brief").alias("brief_name"), F.col("verbose").alias("verbose_name"))


@query("expand_emojis", f"SELECT doc_id, line_no, {D.expand_emojis('text')} AS said, {D.expand_emojis('text', 'de')} AS gesagt FROM {D.lines(D.DOCS2)}")
def expand_emojis(spark, sf_dir):
    text = F.col("text")
    return lines2(spark, sf_dir).select("doc_id", "line_no", rewrite.expand_emojis(text).alias("said"), rewrite.expand_emojis(text, "de").alias("gesagt"))


@query("expand_emoji_char", f"SELECT ch, n, {D.case('ch', {k: v for k, v in SAID.items() if k in '👨👩👧😀'})} AS name FROM {D.CHARS}")
def expand_emoji_char(spark, sf_dir):
    return distinct_chars(spark, sf_dir).select("ch", "n", rewrite.expand_emoji_char(F.col("ch")).alias("name"))


#: An emoticon of each text's own behind the text as it is.
FACES = """text || CASE doc_id % 7 WHEN 0 THEN ' :-) ' WHEN 1 THEN ' x:) ' WHEN 2 THEN ' </3 ' WHEN 3 THEN ' T_T'
 WHEN 4 THEN ' (╯°□°)╯︵ ┻━┻' WHEN 5 THEN ' http://a 8)' ELSE '  D:  ok' END"""


@query("expand_emoticons", f"SELECT doc_id, {D.expand_emoticons('t')} AS said FROM (SELECT doc_id, {FACES} AS t FROM documents)")
def expand_emoticons(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(FACES).alias("t"))
    return rows.select("doc_id", rewrite.expand_emoticons(F.col("t")).alias("said"))


@query("expand_unpronounceable", f"SELECT doc_id, line_no, {D.expand_unpronounceable('text')} AS said FROM {D.lines(D.DOCS2)}")
def expand_unpronounceable(spark, sf_dir):
    rows = lines2(spark, sf_dir)
    names = rewrite.names_in(docs2(spark, sf_dir), "text")
    return rows.select("doc_id", "line_no", rewrite.expand_unpronounceable(F.col("text"), names).alias("said"))


@query("speakable_text", f"SELECT doc_id, line_no, {D.expand_emoticons('s')} AS said FROM (SELECT doc_id, line_no, {D.expand_unpronounceable('text')} AS s FROM {D.lines(D.DOCS2)})")
def speakable_text(spark, sf_dir):
    names = rewrite.names_in(docs2(spark, sf_dir), "text")
    return lines2(spark, sf_dir).select("doc_id", "line_no", rewrite.speakable_text(F.col("text"), names).alias("said"))


@query("speakable_char", f"SELECT ch, n, {D.case('ch', SAID, 'ch')} AS said FROM {D.CHARS}")
def speakable_char(spark, sf_dir):
    names = rewrite.names_in(docs2(spark, sf_dir), "text")
    return distinct_chars(spark, sf_dir).select("ch", "n", rewrite.speakable_char(F.col("ch"), names).alias("said"))


@query(
    "text_table_code",
    """SELECT doc_id, CASE WHEN contains(stem, 'IPA') OR starts_with(stem, 'unicode-braille') THEN NULL ELSE string_split(stem, '-')[1] END AS code
       FROM (SELECT doc_id, regexp_replace(list_last(string_split(path, '/')), '^(.+)\\.[^.]*$', '\\1') AS stem FROM (
         SELECT doc_id, '/usr/share/tables/' || CASE doc_id % 4 WHEN 0 THEN 'IPA.utb' WHEN 1 THEN 'unicode-braille.utb' ELSE lang || '-g1-detailed.ctb' END AS path FROM documents))""".replace("\\\\", "\\"),
)
def text_table_code(spark, sf_dir):
    path = F.expr("'/usr/share/tables/' || CASE doc_id % 4 WHEN 0 THEN 'IPA.utb' WHEN 1 THEN 'unicode-braille.utb' ELSE lang || '-g1-detailed.ctb' END")
    return table(spark, sf_dir, "documents").select("doc_id", X.text_table(path).alias("code"))


@query("lang_display_name", f"SELECT lang, {D.case('lang', T.LANGUAGE_NAMES, 'lang')} AS name, count(*) AS n FROM documents GROUP BY lang")
def lang_display_name(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.select("lang", X.named(F.col("lang"), T.LANGUAGE_NAMES).alias("name"), "n")


@query("script_display_name", f"SELECT script, {D.case('script', T.SCRIPT_NAMES, 'script')} AS name, sum(n)::BIGINT AS n FROM (SELECT {D.script_of('ch')} AS script, n FROM {D.CHARS}) WHERE script IS NOT NULL GROUP BY script")
def script_display_name(spark, sf_dir):
    rows = distinct_chars(spark, sf_dir).select(scripts.char_script(F.col("ch")).alias("script"), "n").where("script is not null")
    return rows.groupBy("script").agg(F.sum("n").alias("n")).select("script", X.named(F.col("script"), T.SCRIPT_NAMES).alias("name"), "n")


VOICE_KIND = "CASE doc_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'hyperlink' WHEN 2 THEN 'uppercase' ELSE NULL END"
VOICE_TEXT = "CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN lang ELSE upper(lang) || '1' END"


@query(
    "voice_overlay",
    f"""SELECT doc_id, CAST(coalesce(CASE WHEN caps OR kind = 'uppercase' THEN NULL WHEN kind = 'hyperlink' THEN 60.0 END, 50.0) AS DOUBLE) AS rate,
        CAST(coalesce(CASE WHEN caps OR kind = 'uppercase' THEN 8.0 WHEN kind = 'hyperlink' THEN NULL END, 5.0) AS DOUBLE) AS pitch FROM (
        SELECT doc_id, {VOICE_KIND} AS kind, coalesce({VOICE_KIND}, 'default') = 'default' AND regexp_matches({VOICE_TEXT}, '^[A-Z]+$') AS caps FROM documents)""",
)
def voice_overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(VOICE_KIND).alias("kind"), F.expr(VOICE_TEXT).alias("t"))
    none = F.lit(None).cast("double")
    voice = X.voice_overlay(
        F.col("kind"), F.col("t"), {"rate": F.lit(50.0), "pitch": F.lit(5.0)}, {"rate": none, "pitch": F.lit(8.0)}, {"rate": F.lit(60.0), "pitch": none}
    )
    return rows.select("doc_id", *[v.alias(k) for k, v in voice.items()])


@query("drop_blank", f"SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '[^{D.S}]')")
def drop_blank(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(~X.is_blank(F.col("text"))).select("conv_id", "turn", "text")


@query("ignored_apps", "SELECT doc_id, source FROM documents WHERE source IS NULL OR lower(upper(source)) NOT IN ('src1', 'src3', 'src7')")
def ignored_apps(spark, sf_dir):
    ignored = spark.createDataFrame([("src1",), ("src3",), ("src7",)], "app string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.join(F.broadcast(ignored), F.lower(F.upper("source")) == F.col("app"), "left_anti")


@query(
    "enabled_only",
    f"SELECT source, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') OR lang IN {T.SENTINELS} GROUP BY ALL",
)
def enabled_only(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.where(scripts.usable(F.col("lang"), F.array(F.lit("en"), F.lit("de"))).isNotNull()).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("needs_expansion", f"SELECT doc_id, line_no FROM {D.lines(D.DOCS2)} WHERE regexp_matches(text, '[{ODD}]')")
def needs_expansion(spark, sf_dir):
    return lines2(spark, sf_dir).where(X.needs_expansion(F.col("text"))).select("doc_id", "line_no")


@query("mixed_eligible", f"SELECT doc_id, line_no, length(w)::INTEGER AS words FROM (SELECT doc_id, line_no, {D.words('text')} AS w FROM {D.lines(D.DOCS2)}) WHERE length(w) BETWEEN 8 AND 600")
def mixed_eligible(spark, sf_dir):
    rows = lines2(spark, sf_dir).where(X.mixed_eligible(F.col("text"), F.lit(4)))
    return rows.select("doc_id", "line_no", F.size(X.words(F.col("text"))).alias("words"))


@query(
    "search_char_names",
    f"""SELECT ch, n, {D.case('ch', SAID)} AS brief_name, {D.case('ch', VERBOSE)} AS verbose_name FROM {D.CHARS}
        WHERE contains(coalesce({D.case('ch', SAID)}, ''), 'right') OR contains(coalesce({D.case('ch', VERBOSE)}, ''), 'right')""",
)
def search_char_names(spark, sf_dir):
    names = chars.char_dimension(spark).select("ch", "unicode_name", "brief", "verbose")
    rows = distinct_chars(spark, sf_dir).join(F.broadcast(names), "ch")
    hit = F.greatest(*[F.coalesce(F.lower(c).contains("right"), F.lit(False)) for c in ("ch", "unicode_name", "brief", "verbose")])
    return rows.where(hit).select("ch", "n", F.col("brief").alias("brief_name"), F.col("verbose").alias("verbose_name"))


@query(
    "script_counts",
    f"""SELECT doc_id, {D.script_of('ch')} AS script, count(*)::INTEGER AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM {D.DOCS2})
        WHERE regexp_matches(ch, '[^\\x{{0}}-\\x{{24f}}]') AND {D.script_of('ch')} <> 'LATIN' GROUP BY ALL""",
)
def script_counts(spark, sf_dir):
    rows = docs2(spark, sf_dir).select("doc_id", F.explode(scripts.script_counts(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.script", "s.n")


@query("letters_total", f"SELECT doc_id, length(regexp_extract_all(text, '{scripts.LETTERS}'))::INTEGER AS letters FROM {D.DOCS2}")
def letters_total(spark, sf_dir):
    return docs2(spark, sf_dir).select("doc_id", scripts.letters_total(F.col("text")).alias("letters"))


#: Whole texts, and the written-in part once more as a line of its own, which has a dominant script.
SCRIPT_LINES = D.lines(f"(SELECT doc_id, source, lang, {U.INJECTED} || chr(10) || right({U.INJECTED}, length({U.INJECTED}) - length(text)) AS text FROM documents)")
KEYED_LINES = f"(SELECT doc_id, line_no, concat_ws('/', doc_id, line_no) AS k, text FROM {SCRIPT_LINES})"
DOMINANT = f"(SELECT doc_id, line_no, dominant FROM {KEYED_LINES} JOIN {D.dominant(KEYED_LINES, 'k')} USING (k))"


@query("dominant_script", f"SELECT doc_id, line_no, dominant FROM {DOMINANT}")
def dominant_script(spark, sf_dir):
    """The dominant script of every whole line."""
    part = f"{U.INJECTED} || chr(10) || right({U.INJECTED}, length({U.INJECTED}) - length(text))"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(part).alias("text"))
    return U.lines(docs).select("doc_id", "line_no", scripts.dominant_script(F.col("text")).alias("dominant"))


#: Whole texts as rows of even number; the written-in parts alone, which have a dominant script, as rows of odd number.
WHOLE_DOCS = f"""(SELECT 2 * doc_id AS row_id, {U.INJECTED} AS text FROM documents
    UNION ALL SELECT 2 * doc_id + 1 AS row_id, right({U.INJECTED}, length({U.INJECTED}) - length(text)) AS text FROM documents)"""


def whole_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.expr(f"right({U.INJECTED}, length({U.INJECTED}) - length(text))")
    whole = docs.select((2 * F.col("doc_id")).alias("row_id"), F.expr(U.INJECTED).alias("text"))
    return whole.union(docs.select((2 * F.col("doc_id") + 1).alias("row_id"), part.alias("text")))


@query("dominant_script_whole", f"SELECT row_id, dominant FROM {D.dominant(WHOLE_DOCS, 'row_id')}")
def dominant_script_whole(spark, sf_dir):
    return whole_docs(spark, sf_dir).select("row_id", scripts.dominant_script(F.col("text")).alias("dominant"))


@query(
    "script_to_language_whole",
    f"SELECT row_id, dominant, {D.case('dominant', T.SCRIPT_LANGUAGES)} AS lang FROM {D.dominant(WHOLE_DOCS, 'row_id')}",
)
def script_to_language_whole(spark, sf_dir):
    known = spark.createDataFrame(list(T.SCRIPT_LANGUAGES.items()), "dominant string, lang string")
    return dominant_script_whole(spark, sf_dir).join(F.broadcast(known), "dominant", "left").select("row_id", "dominant", "lang")


@query("natural_word_count", f"SELECT doc_id, line_no, length({D.natural_words('text')})::INTEGER AS n FROM {D.lines(D.DOCS2)}")
def natural_word_count(spark, sf_dir):
    return lines2(spark, sf_dir).select("doc_id", "line_no", F.size(X.natural_words(F.col("text"))).alias("n"))


@query("script_to_language", f"SELECT doc_id, line_no, dominant, {D.case('dominant', T.SCRIPT_LANGUAGES)} AS lang FROM {DOMINANT}")
def script_to_language(spark, sf_dir):
    known = spark.createDataFrame(list(T.SCRIPT_LANGUAGES.items()), "dominant string, lang string")
    return dominant_script(spark, sf_dir).join(F.broadcast(known), "dominant", "left").select("doc_id", "line_no", "dominant", "lang")


@query("detect_character", f"SELECT ch, n, CASE WHEN l IN ('ru', 'he', 'ipa', 'unicode_braille') THEN l END AS lang FROM (SELECT ch, n, {D.case(D.script_of('ch'), T.SCRIPT_LANGUAGES)} AS l FROM {D.CHARS})")
def detect_character(spark, sf_dir):
    """Language of single characters by script alone, where Russian and Hebrew are enabled."""
    lang = scripts.script_language(scripts.char_script(F.col("ch")))
    return distinct_chars(spark, sf_dir).select("ch", "n", scripts.usable(lang, F.array(F.lit("ru"), F.lit("he"))).alias("lang"))


@query(
    "char_runs",
    """SELECT doc_id, ch, run::INTEGER AS run, count(*) AS n FROM (SELECT doc_id, ch, count(*) AS run FROM (
         SELECT doc_id, ch, i, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS island FROM (
           SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM """
    + D.DOCS2
    + """)) GROUP BY doc_id, ch, island) WHERE run > 1 GROUP BY ALL""",
)
def char_runs(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(.)\1+"), F.lit(0))).alias("r")
    rows = docs2(spark, sf_dir).select("doc_id", found).select("doc_id", F.regexp_extract("r", "(?s)^.", 0).alias("ch"), F.length("r").alias("run"))
    return rows.groupBy("doc_id", "ch", "run").agg(F.count("*").alias("n"))


@query(
    "sentence_chunks",
    rf"""WITH s AS (SELECT doc_id, p, part, {D.words('part')} AS w FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM (
           SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[{D.S}]+', '\1' || chr(1), 'g'), '\x{{1}}|\n+') AS parts FROM {D.DOCS2}))),
         g AS (SELECT doc_id, p, part, w, unnest(range(0, greatest(length(w), 1), 40)) AS k FROM s)
         SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS INTEGER) AS chunk_no,
                CASE WHEN length(w) <= 40 THEN part ELSE array_to_string(w[k + 1:k + 40], ' ') END AS chunk FROM g""",
)
def sentence_chunks(spark, sf_dir):
    return docs2(spark, sf_dir).select("doc_id", F.posexplode(X.sentence_chunks(F.col("text"))).alias("chunk_no", "chunk"))
