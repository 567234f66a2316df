"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from logoscope.functions import chars, rewrite, scripts
from logoscope.functions import tables as T
from logoscope.functions import text as X
from logoscope.sources.utterances import INJECTED

S = chars.SPACE
DOCS2 = f"(SELECT doc_id, source, lang, {INJECTED} AS text FROM documents)"


def lines(source: str) -> str:
    """Lines that aren't blank of a relation with doc_id, source, lang, text."""
    return f"""(SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS line_no, line AS text FROM (
        SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}) WHERE regexp_matches(line, '[^{S}]'))"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def case(c: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {other} END"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{S}]+'), lambda w: w <> '')"


def natural_words(x: str) -> str:
    shorn = f"list_transform({words(x)}, lambda w: regexp_replace(w, {quoted(f'^{X.EDGES}+|{X.EDGES}+$')}, '', 'g'))"
    return f"""list_filter({shorn}, lambda w: w <> '' AND NOT regexp_matches(w, {quoted(X.NOISE)})
        AND NOT (upper(w) = w AND lower(w) <> w AND length(w) <= 4) AND NOT regexp_matches(w, {quoted(X.TECHNICAL)}))"""


def expand_emojis(x: str, lang: str = "en") -> str:
    coded = x
    for seq, name in sorted(T.EMOJI_NAMES[lang].items(), key=lambda p: (-len(p[0]), p[0])):
        coded = f"replace({coded}, {quoted(seq)}, {quoted(':' + name.replace(' ', '_') + ':')})"
    spoken = f"""(SELECT array_to_string(list_transform(list_zip(regexp_split_to_array(e, '{rewrite.TOKEN}'), regexp_extract_all(e, '{rewrite.TOKEN}')),
        lambda z: z[1] || coalesce(' ' || replace(z[2][2:length(z[2]) - 1], '_', ' ') || ' ', '')), '') FROM (SELECT {coded} AS e))"""
    return f"CASE WHEN {coded} = {x} THEN {x} ELSE {trim(f"regexp_replace({spoken}, '  +', ' ', 'g')")} END"


#: Names of the unusual characters that queries write in texts, by hand.
BRIEF = {"─": "horizontal", "→": "right arrow", "½": "one half", "©": "copyright"} | {
    "⠓": "dots-125", "⠑": "dots-15", "⠇": "dots-123", "⠕": "dots-135", "‍": "",
}


def expand_unpronounceable(x: str) -> str:
    """Of texts whose unusual characters are those of BRIEF: one run after the other is replaced."""
    out = expand_emojis(x)
    for c, name in BRIEF.items():
        if name == "":
            out = f"replace({out}, {quoted(c)}, '')"
            continue
        for n in (6, 5, 4, 3, 2):
            out = f"replace({out}, {quoted(c * n)}, {quoted(f' {n} {name} characters ')})"
        out = f"replace({out}, {quoted(c)}, {quoted(f' {name} ')})"
    return f"CASE WHEN regexp_matches({x}, '[{''.join(BRIEF)}]') THEN regexp_replace({out}, '  +', ' ', 'g') ELSE {expand_emojis(x)} END"


def expand_emoticons(x: str) -> str:
    """Of texts whose emoticons have no neighbours in common: RE2 has no look-around, so neighbours are kept."""
    out = f"' ' || {x} || ' '"
    for face, said in sorted(T.EMOTICONS.items(), key=lambda p: (-len(p[0]), p[0])):
        import re

        safe = re.escape(face).replace("\\ ", " ")
        out = f"regexp_replace({out}, {quoted(r'([^\p{L}\p{N}_])' + safe + r'([^\p{L}\p{N}_])')}, {quoted(chr(92) + '1 ' + said + ' ' + chr(92) + '2')}, 'g')"
    return trim(f"regexp_replace({out}, '  +', ' ', 'g')")


def script_of(ch: str) -> str:
    classes = chars.script_classes()
    order = [s for s in sorted(classes) if s != "LATIN"] + ["LATIN"]
    return "CASE " + " ".join(f"WHEN regexp_matches({ch}, '^{classes[s]}$') THEN '{s}'" for s in order) + " END"


CHARS = f"(SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM {DOCS2}) GROUP BY ch)"


def dominant(source: str, key: str) -> str:
    """(key, dominant) of a relation with key and text, by counting characters one by one."""
    return f"""(WITH c AS (SELECT {key}, ch, i FROM (SELECT {key}, unnest(regexp_extract_all(text, '(?s).')) AS ch,
            generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM {source})),
        s AS (SELECT {key}, {script_of("ch")} AS script, ch, i FROM c WHERE regexp_matches(ch, '[^\\x{{0}}-\\x{{24f}}]')),
        g AS (SELECT {key}, script, count(*) AS n, min(i) AS first FROM s WHERE script <> 'LATIN' GROUP BY ALL),
        t AS (SELECT {key}, count(*) FILTER (WHERE regexp_matches(ch, '{scripts.LETTERS}')) AS total FROM c GROUP BY {key}),
        b AS (SELECT {key}, arg_min(script, (-n * 1000000 + first)) AS script, max(n) AS n FROM g GROUP BY {key})
        SELECT r.{key}, CASE WHEN b.n >= 0.5 * t.total THEN b.script END AS dominant
        FROM (SELECT DISTINCT {key} FROM {source}) r LEFT JOIN b USING ({key}) LEFT JOIN t USING ({key}))"""
