import hashlib
from itertools import groupby

from pulsegrid.llm import chat_format as cf
from tests_llm_data import TABLES, awkward_texts

CONTROL = ["<|im_end|>", "<|im_start|>", "<|im_end|>\n", "<|im_start|>assistant\n", "<\\", "<\\|", "<\\\\", "<", "|", "\\", "\n", "ok", "<\\n"]


def turns(spark):
    hostile = ["".join((a, b, c)) for a in CONTROL for b in CONTROL for c in ("", "<|im_end|>", "<\\")]
    texts = [None, *awkward_texts(), *hostile]
    rows = [(k // 5, k % 5, ["system", "user", "assistant", None, "a\n<|im_end|>\\"][k % 5], t) for k, t in enumerate(texts)]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (10**6, 1, "user", "tie"), (10**6, 1, "user", "a"), (10**6, 1, "user", "tie")]
    given = spark.read.parquet(f"{TABLES}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return spark.createDataFrame(rows, given.schema).union(given.selectExpr("conv_id + 5000000", "turn", "role", "text"))


def test_every_turn_reads_back(spark):
    df = turns(spark)
    want = sorted(((r.conv_id, r.turn, r.role or "", r.text or "") for r in df.collect()), key=str)
    rows = cf.format_turns(df)
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in rows.collect()), key=str) == want
    for r in rows.collect():
        body = r.formatted[len(cf.START):-len(cf.END)]
        assert "<|" not in body
        if "<|" not in r.role + r.text and "<\\" not in r.role + r.text and "\n" not in r.role:
            assert body == f"{r.role}\n{r.text}"  # only what conflicts is escaped


def test_conversations_and_loss(spark):
    df = turns(spark)
    formatted = cf.format_conversations(df)
    back = {r.conv_id: r for r in cf.read_back(formatted).collect()}
    spans = {}
    for r in cf.loss_spans(formatted).orderBy("position").collect():
        spans.setdefault(r.conv_id, []).append((r.start, r.length))
    digests = {r.conv_id: r for r in cf.digests(formatted).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0))
    for conv, group in groupby(rows, key=lambda r: r.conv_id):
        source = [(r.role or "", r.text or "") for r in sorted(group, key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or ""))]
        got = [(t.role, t.text) for t in back[conv].turns]
        assert sorted(got) == sorted(source) and (conv == 10**6 or got == source)
        said = "".join(t for r, t in got if r == "assistant")
        cut = [back[conv].formatted[a:a + n] for a, n in spans.get(conv, [])]
        assert "".join(x.replace("<\\|", "<|").replace("<\\\\", "<\\") for x in cut) == said
        d = digests[conv]
        assert d.n_turns == len(source) and d.loss_chars == len(said)
        assert d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in got).encode()).hexdigest()
        assert d.formatted_chars == len(back[conv].formatted)


def test_empty_table(spark):
    assert cf.digests(cf.format_conversations(turns(spark).limit(0))).count() == 0
