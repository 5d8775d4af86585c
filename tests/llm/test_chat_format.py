import hashlib
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from plaintscope.llm import chat_format as cf

HARD = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] x", "<s>", "</s>", "<</s>", "[INST", "</s", "[ROLE]a[TEXT]b[/ROLE]", "\\", "$1 \\2", "a\nb", "", "😀 é",
        "[/INST][/INST]", "<\\s>", "<s></s>", "[[/INST]]"]
ROLES = ["user", "assistant", "system", "tool", "[TEXT]", "a[TEXT]b[/ROLE]", "", "User", "</s>"]


def check(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cf.format_conversations(turns).collect()}
    source = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        source.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == source.keys()
    for c, want in source.items():
        g = got[c]
        assert g.exact and g.n_turns == len(want) and [(t.role, t.text) for t in g.turns] == want
        learned = [g.formatted[m.start:m.stop] for m in g.loss_mask]
        assert len(learned) == sum(r == "assistant" for r, _ in want)
        assert [re.sub(cf.ESCAPED_MARK, r"\1\2\3", a) for a in learned] == [x for r, x in want if r == "assistant"]
    digest = {r.conv_id: r for r in cf.digests(cf.format_conversations(turns)).collect()}
    for c, want in source.items():
        said = "".join(x for r, x in want if r == "assistant")
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
        assert (digest[c].loss_chars, digest[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_all_hard_texts_in_all_roles(spark):
    rows = [(k, t, role, text) for k, role in enumerate(ROLES) for t, text in enumerate(HARD)]
    rows += [(100, 0, None, None), (100, 0, None, None), (100, None, "assistant", None), (None, 1, "user", "x"), (None, 0, "assistant", "</s>")]
    rows += [(101, 0, "user", "long [INST] </s> " * 20_000)]
    check(spark, rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.sampled_from(ROLES),
                          st.lists(st.sampled_from([*"[]</>\\s", "INST]", "[/INST]", "</s>", "ROLE]", "TEXT]"]), max_size=8).map("".join)), min_size=1, max_size=40))
def test_any_mix_of_marks(spark, rows):
    check(spark, rows)


def test_unmarked_texts_stay_as_they_are(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "there [INST]")]
    got = cf.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == "[INST]hi[/INST]<s>there [INST]</s>"
    assert cf.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_the_mask_tells_what_is_learned_and_a_shifted_one_shows(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "one </s> two"), (1, 2, "assistant", "three")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for column in ("formatted", "turns", "said", "start", "size", "loss_mask"):
        turns = turns.withColumn(column, F.lit("x"))
    made = cf.format_conversations(turns)
    want = hashlib.sha256("one </s> twothree".encode()).hexdigest()
    assert cf.digests(made).first().loss_sha256 == want
    shifted = F.transform("loss_mask", lambda m: F.struct((m["start"] + 1).alias("start"), (m["stop"] + 1).alias("stop")))
    assert cf.digests(made.withColumn("loss_mask", shifted)).first().loss_sha256 != want


def test_the_mask_holds_where_all_turns_are_escaped(spark, monkeypatch):
    """Force the last resort: a parser that takes no joined conversation as it is, but all escaped ones."""
    rows = [(1, 0, "user", "[INST"), (1, 1, "assistant", "a </s> b"), (1, 2, "user", "\\ [/INST]"), (1, 3, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parse, calls = cf.parse, []

    def strict(formatted):
        calls.append(1)
        return F.slice(parse(formatted), 1, 1) if len(calls) == 2 else parse(formatted)

    monkeypatch.setattr(cf, "parse", strict)
    got = cf.format_conversations(turns).first()
    assert got.exact and got.formatted.count("\\") > 2
    assert [re.sub(cf.ESCAPED_MARK, r"\1\2\3", got.formatted[m.start:m.stop]) for m in got.loss_mask] == ["a </s> b", ""]


def test_only_built_in_expressions(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = cf.digests(cf.format_conversations(turns))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert plan.count("Exchange hashpartitioning") == 1
