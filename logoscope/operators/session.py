"""The damping state machine of a session: a language is left only for a sure or a repeated detection.

``Session.step`` takes one utterance after the other; the stream processor takes the same steps. In batch, rows are dealt
by ranges of (session, seq), so a session with very many rows lies in many ranges, each of which is one pass with a state of
constant size. At the start of a range the state that its session has by then isn't known: ``Opening`` takes the steps for
every state that it can be, until these have become one. What a range makes of a state is folded over the ranges of a session
in order, a row a range, and then settles what was spoken before that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logoscope.functions.tables import SENTINELS
from logoscope.sources.scratch import scratch

#: Defaults: repeated detections (or words) that switch, least confidence and words to leave the default language.
THRESHOLD, SURE, LEAST_WORDS = 2, 0.92, 3


@dataclass
class Session:
    """State of one session; ``heard`` holds the last equal detections that have not switched, fewer than ``threshold``.

    ``statistical`` false leaves detection by script alone; ``fallback`` false gives null where there is no signal, instead
    of the current language, and leaves the state as it is where a script is found."""

    default: str = "en"
    threshold: int = THRESHOLD
    sure: float = SURE
    current: str | None = None
    heard: list[str] = field(default_factory=list)
    statistical: bool = True
    fallback: bool = True

    def _become(self, lang: str) -> str:
        self.current, self.heard = lang, []
        return lang

    def step(self, script: str | None, lang: str | None, conf: float | None, words: int | None, hint: str | None = None) -> str | None:
        """Language in which an utterance is spoken. ``script`` is its language by script; ``lang`` the detected one, null
        for text without words, and ``words`` null for blank text; a ``hint`` (with a voice) becomes current, and
        detections heard before stay."""
        if hint is not None:
            self.current = hint
            return hint
        if script in SENTINELS:
            return script
        if script is not None:
            return self._become(script) if self.fallback else script
        if words is None or not self.statistical:
            return self.current if self.fallback else None
        if lang is None:
            return self.current
        if lang == self.current:
            return self._become(lang)
        leaving = self.current == self.default
        if leaving and (conf or 0.0) < self.sure:
            return self.current
        enough = words >= LEAST_WORDS or not leaving
        if enough and words >= self.threshold:
            return self._become(lang)
        self.heard = [*self.heard, lang] if self.heard[-1:] == [lang] else [lang]
        return self._become(lang) if len(self.heard) >= self.threshold else self.current

    def compares(self, script: str | None, lang: str | None, words: int | None, hint: str | None) -> bool:
        """Whether a step of these holds ``lang`` against the state."""
        return hint is None and script is None and lang is not None and words is not None and self.statistical

    @property
    def state(self) -> tuple[str | None, str, int]:
        """The current language, the one heard last and how often."""
        return self.current, self.heard[-1] if self.heard else "", len(self.heard)

    @state.setter
    def state(self, to: tuple[str | None, str, int]) -> None:
        self.current, self.heard = to[0], [to[1]] * to[2]


#: Stands for the language that a session had, or had heard, before a range, where it is none that the range has met.
BEFORE = "\0"


class Opening:
    """The machine over the first rows of a range, for every state before it.

    States that have taken the same steps so far are one class. ``eras`` has, for each stretch of rows in which classes
    are the same, the class of each state before; languages that no row has been compared with are BEFORE there. A language
    that is compared for the first time divides classes, and classes that come to the same state are joined."""

    def __init__(self, session: Session):
        self.session, self.met = session, []
        self.states = [(BEFORE, BEFORE, 1)]
        self.class_of = {(BEFORE, BEFORE, 1): 0}
        self.eras: list[list] = []
        self._meet(session.default)

    def _era(self) -> None:
        self.eras.append([[*before, k] for before, k in self.class_of.items()])

    def _regroup(self, state_of: dict) -> None:
        number: dict = {}
        self.class_of = {before: number.setdefault(state, len(number)) for before, state in state_of.items()}
        self.states = list(number)
        self._era()

    def _meet(self, lang: str) -> None:
        self.met.append(lang)
        runs = [(lang, n) for n in range(1, self.session.threshold)]
        state_of = {}
        for (was, heard, times), k in self.class_of.items():
            current, last, n = self.states[k]
            for c in [BEFORE, lang] if was == BEFORE else [was]:
                for run in [(BEFORE, 1), *runs] if heard == BEFORE else [(heard, times)]:
                    state_of[c, *run] = (c if current == BEFORE else current, *(run if last == BEFORE else (last, n)))
        self._regroup(state_of)

    def step(self, *row) -> tuple[int, list[str | None]]:
        """(era, what each class speaks): BEFORE is the language before the range."""
        script, lang, _, words, hint = row
        if lang not in self.met and self.session.compares(script, lang, words, hint):
            self._meet(lang)
        era, spoken, after = len(self.eras) - 1, [], []
        for state in self.states:
            self.session.state = state
            spoken.append(self.session.step(*row))
            after.append(self.session.state)
        if len(set(after)) < len(after):
            self._regroup({before: after[k] for before, k in self.class_of.items()})
        else:
            self.states = after
        return era, spoken

    @property
    def settled(self) -> bool:
        return len(self.states) == 1 and BEFORE not in self.states[0]


def _classes(eras: list, state: tuple) -> list[int]:
    """The class of ``state`` in each era."""
    found = []
    for era in eras:
        of = {tuple(x[:3]): x[3] for x in era}
        met = {x[0] for x in era}
        current, heard, n = state
        found.append(of[(current if current in met else BEFORE), *((heard, n) if n and heard in met else (BEFORE, 1))])
    return found


def _folded(edges: DataFrame, default: str, kind: str) -> DataFrame:
    """(part, classes, was) of every range: class of the state of its first session in each era, and current language.

    ``edges`` (session, part, opening, out) has the first and the last session of each range, with the states that the range
    leaves; sessions are folded in parallel, one range after the other."""

    def run(batches):
        state, of = None, object()
        for b in batches:
            made = []
            for session, part, opening, out in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if session != of:
                    of, state = session, (default, "", 0)
                out = [tuple(x) for x in json.loads(out)]
                if opening is None:
                    state = out[0]
                    continue
                classes = _classes(json.loads(opening), state)
                made.append((part, classes, state[0]))
                current, heard, n = out[classes[-1]]
                state = (state[0] if current == BEFORE else current, *(state[1:] if heard == BEFORE else (heard, n)))
            columns = [[m[i] for m in made] for i in range(3)]
            types = [pa.int32(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "classes", "was"])

    dealt = edges.select("session", "part", "opening", "out").repartition("session").sortWithinPartitions("session", "part")
    return dealt.mapInArrow(run, "part int, classes array<int>, was string")


def session_language(
    rows: DataFrame,
    default: str = "en",
    threshold: int = THRESHOLD,
    sure: float = SURE,
    statistical: bool = True,
    fallback: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """``rows`` (session, seq, script_lang, lang, conf, words, hint) with the language that is spoken.

    Sessions begin in the default language. Null sessions are one session. Order within a session is by seq, null first;
    rows of one seq go by their other columns. ``ranges`` is the number of tasks that share the rows, whatever the lengths of
    sessions (null: as many as a shuffle has). Extra columns are ignored; an empty table gives no rows. The result is read
    from a table of the scratch folder."""
    spark = rows.sparkSession
    session_type, seq_type = (rows.schema[c].dataType.simpleString() for c in ("session", "seq"))
    new = lambda: Session(default, max(1, threshold), sure, default, [], statistical, fallback)
    names = ["session", "seq", "spoken", "part", "era", "said", "opening", "out"]

    def run(batches):
        from pyspark import TaskContext

        part, opening, state, first, of, last = TaskContext.get().partitionId(), None, None, True, None, None
        kept, eras, types = None, None, None

        def edge(session, opened, states):
            made = [[session], [None], [None], [part], [None], [None], [opened], [json.dumps(states)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types, strict=True)], names)

        for b in batches:
            types = types or [b.column(0).type, b.column(1).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
            spoken, era, said = [], [], []
            columns = [b.column(i).to_pylist() for i in range(7)]
            for session, _, *row in zip(*columns, strict=True):
                if first:
                    first, of, opening = False, session, Opening(new())
                elif session != of:
                    if eras is None:  # the first session ends here
                        eras = json.dumps(opening.eras)
                        yield edge(of, eras, [state.state] if state else opening.states)
                    of, state, last = session, new(), True
                if state is None:
                    e, by_class = opening.step(*row)
                    spoken.append(None)
                    era.append(e)
                    said.append(by_class)
                    if opening.settled:
                        state = new()
                        state.state = opening.states[0]
                else:
                    spoken.append(state.step(*row))
                    era.append(None)
                    said.append(None)
            n = b.num_rows
            rest = [pa.array(x, t) for x, t in zip([spoken, [part] * n, era, said, [None] * n, [None] * n], types[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rest], names)
        if not first and eras is None:
            yield edge(of, json.dumps(opening.eras), [state.state] if state else opening.states)
        elif last:
            yield edge(of, None, [state.state])

    columns = ["session", "seq", "script_lang", "lang", "conf", "words", "hint"]
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first, as dealing by range reads its input twice and detection is dear
    given, path = scratch(spark, "detections"), scratch(spark, "sessions")
    rows.select(*columns).write.parquet(given)
    dealt = spark.read.schema(rows.select(*columns).schema).parquet(given)
    dealt = dealt.repartitionByRange(count, "session", "seq").sortWithinPartitions(*columns)
    schema = f"session {session_type}, seq {seq_type}, spoken string, part int, era int, said array<string>, opening string, out string"
    made = dealt.mapInArrow(run, schema)
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    before = _folded(made.where("out IS NOT NULL"), default, session_type)
    found = made.where("out IS NULL").select("session", "seq", "spoken", "part", "era", "said").join(F.broadcast(before), "part", "left")
    answer = F.get(F.col("said"), F.get(F.col("classes"), F.col("era")))
    spoken = F.when(F.col("era").isNull(), F.col("spoken")).otherwise(F.when(answer == BEFORE, F.col("was")).otherwise(answer))
    return found.select("session", "seq", spoken.alias("spoken"))
