import json
import os
import tempfile

import pytest

from lectern.operators import errors as ER
from lectern.operators import mt_metrics as MT
from lectern.operators import vocab as VB
from lectern.sinks import writers as WR
from lectern.sources import parallel as PA


def test_read_parallel_csv(spark):
    d = tempfile.mkdtemp(prefix="lectern-csv-")
    p = os.path.join(d, "test.csv")
    with open(p, "w") as f:
        f.write('std_text,ife_text,ilaje_text,ijebu_text,english_text\n'
                '"a, b","multi\nline",,x,"say ""hi"""\n')
    r = PA.read_parallel(spark, p).collect()[0]
    assert r.std_text == "a, b" and r.ife_text == "multi\nline" and r.ilaje_text is None
    assert r.english_text == 'say "hi"' and r.row_id is not None


def test_read_bitext_positions(spark):
    d = tempfile.mkdtemp(prefix="lectern-tsv-")
    p = os.path.join(d, "train.tsv")
    open(p, "w").write("h1\th2\ntarget one\tsource one\n")
    f = PA.read_bitext(spark, p).collect()[0]
    r = PA.read_bitext(spark, p, reverse=True).collect()[0]
    assert (f.src_txt, f.tgt_txt) == ("source one", "target one")
    assert (r.src_txt, r.tgt_txt) == ("target one", "source one")


def test_columns_by_name_and_missing_values(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("english_text,extra,std_text,ife_text,ilaje_text,ijebu_text\nE,x,S,NA, nan ,null\n")
    r = PA.read_parallel(spark, str(p)).first()
    assert (r.english_text, r.std_text, r.ife_text, r.ilaje_text, r.ijebu_text) == ("E", "S", None, " nan ", None)
    assert PA.read_parallel(spark, str(p), multi_line=False).first().std_text == "S"
    with pytest.raises(ValueError, match="English not found; available: english_text, extra"):
        PA.read_parallel(spark, str(p), ["English"])
    t = tmp_path / "t.tsv"
    t.write_text('a\tb\n"say ""hi""\tthere"\t"two\nlines"\nNA\tx\n')
    got = {(r.tgt_txt, r.src_txt) for r in PA.read_bitext(spark, str(t)).collect()}
    assert got == {('say "hi"\tthere', "two\nlines"), (None, "x")}


def test_scorecard_vocab_report(spark):
    pairs = spark.createDataFrame([(0, "g a", "a b c d", "a b c d"), (1, "g b", "x y", "x z")],
                                  "k int, grp string, ref string, hyp string")
    wide = MT.corpus_scores(pairs, ["k"], by=["grp"])
    card = MT.scorecard(wide, "grp", ["bleu", "chrf"])
    d = tempfile.mkdtemp(prefix="lectern-out-")
    WR.write_scorecard(card, os.path.join(d, "scores"))
    txt = "".join(open(os.path.join(d, "scores", f)).read() for f in os.listdir(os.path.join(d, "scores"))
                  if f.startswith("part-"))
    obj = json.loads(txt)
    assert set(obj) == {"g_a_bleu", "g_a_chrf", "g_b_bleu", "g_b_chrf"}
    vocab = VB.char_vocab(pairs, "ref")
    WR.write_vocab(vocab, os.path.join(d, "vocab"))
    rep = ER.asr_report(pairs)
    WR.write_pair_report(rep, pairs, os.path.join(d, "report"), ["k"])
    files = sorted(f for f in os.listdir(os.path.join(d, "report")) if f.startswith("part-"))
    lines = "".join(open(os.path.join(d, "report", f)).read() for f in files).split("\n")
    assert lines[1].startswith("WER: ") and lines[8] == "REF: a b c d" and lines[10] == "-" * 54
    assert lines[11] == "REF: x y"
