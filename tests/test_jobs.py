import json
import os
import tempfile

from lectern.plans import jobs
from lectern.plans import stub_models as SM
from tests.test_audio import _wav


def test_mt_eval_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="lectern-mt-")
    p = os.path.join(d, "test.csv")
    with open(p, "w") as f:
        f.write("std_text,ife_text,ilaje_text,ijebu_text,english_text\n"
                "a b c d,d c b a,x,,d c b a\n"
                "one two three four,four three two one,y y,z,four three two one\n")
    out = jobs.mt_eval(spark, p, SM.reverse_words_model, d, make_scorer=SM.length_ratio_model)
    w = out["translations"].collect()
    assert len(w) == 2 and "std_text bleu" in out["translations"].columns
    card = {r.key: r.score for r in out["scorecard"].collect()}
    assert round(card["std_text_bleu"], 6) == 100.0 and "ijebu_text_comet" in card


def test_prepare_speech_and_asr_eval(spark):
    root = tempfile.mkdtemp(prefix="lectern-prep-")
    os.makedirs(os.path.join(root, "train"))
    _wav(os.path.join(root, "train", "a.wav"), 16000, 1.0)
    _wav(os.path.join(root, "train", "b.wav"), 16000, 20.0)
    with open(os.path.join(root, "train", "metadata.csv"), "w") as f:
        f.write("file_name,transcription\na.wav,\"Hello, World!\"\nb.wav,too long\n")
    out = tempfile.mkdtemp(prefix="lectern-prep-out-")
    prepared = jobs.prepare_speech(spark, root, out).collect()
    assert len(prepared) == 1 and prepared[0].input_length == 16000
    vocab_file = [f for f in os.listdir(os.path.join(out, "vocab")) if f.startswith("part-")][0]
    vocab = json.load(open(os.path.join(out, "vocab", vocab_file)))
    assert "|" in vocab and vocab["[PAD]"] == vocab["[UNK]"] + 1
    rep = jobs.asr_eval(spark, root, SM.clip_length_asr_model, out).collect()[0]
    assert rep.n_pairs == 2
    w = prepared[0]
    assert [i for i in w.labels] == [vocab["|" if c == " " else c] for c in "hello world "]
    assert {"t", "g"} <= set(vocab)  # of the clip that is too long
    assert len(jobs.prepare_speech(spark, root, tempfile.mkdtemp(), caps={"train": 1}).collect()) == 1
    none = jobs.asr_eval(spark, root, SM.clip_length_asr_model, tempfile.mkdtemp(), split="test").first()
    assert none.n_pairs == 0 and none.n_failed == 0


def test_asr_eval_of_logits_counts_lost_rows(spark, tmp_path):
    def model():
        def f(clips):
            if any(len(s) > 16000 for s, _ in clips):
                raise ValueError("too long")
            return [[[0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]] for _ in clips]
        return f

    (tmp_path / "test").mkdir()
    for name, seconds in (("a", 1.0), ("b", 2.0), ("c", 1.0)):
        _wav(str(tmp_path / "test" / f"{name}.wav"), 16000, seconds)
    (tmp_path / "test" / "metadata.csv").write_text("file_name,transcription\na.wav,ba\nb.wav,ba\nc.wav,ba\n")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("[PAD]", 2)], "token string, id int")
    rep = jobs.asr_eval(spark, str(tmp_path), model, str(tmp_path / "out"), split="test", cap_n=2, logits=(vocab, 2)).first()
    assert (rep.n_pairs, rep.n_failed, rep.wer, rep.cer) == (1, 1, 0.0, 0.0)


def test_prepare_text_with_validation(spark, tmp_path):
    head = "English,Ife Dialect,Ilaje Dialect,Ijebu Dialect,Standard Yoruba\n"
    (tmp_path / "t.csv").write_text(head + "e1,\u201ci\u201d,l,j,s\n")
    (tmp_path / "v.csv").write_text(head + "e2,i2,l2,j2,s2\n")
    (tmp_path / "x.tsv").write_text("t\ts\ntgt\tsrc\n")
    out = jobs.prepare_text(spark, str(tmp_path / "t.csv"), str(tmp_path / "x.tsv"), validation_csv=str(tmp_path / "v.csv"),
                            out_dir=str(tmp_path / "out"))
    got = {(r.split, r.dialect, r.src_txt, r.tgt_txt) for r in out.collect()}
    assert len(got) == 9 and ("train", "Ife Dialect", '"i"', "e1") in got and ("train", None, "src", "tgt") in got
    assert ("validation", "Standard Yoruba", "s2", "e2") in got
