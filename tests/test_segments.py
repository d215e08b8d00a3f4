"""The query of pinyin segments on tokens of any length, against all ways to cut them."""

from namelens.functions import dims
from namelens.plans import catalog

TOKENS = ["shuangzhuangchuang", "zhuangshuangxiang", "xianggangdaxue", "misunderstanding", "internationalization", "fangan", "xian", "smith", "zhongguorenmindaxue"]


def cuts(w):
    """Every way to cut w into syllables, last syllable first."""
    if not w:
        return [[]]
    return [[w[i:], *rest] for i in range(len(w)) if w[i:] in dims.SYLLABLES for rest in cuts(w[:i])]


def test_pinyin_segments_keep_long_tokens(spark, tmp_path):
    text = " ".join(TOKENS).title() + " 汉字 " + TOKENS[0]
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: (r["valid"], r["n_syllables"], r["syllables"]) for r in catalog.pinyin_segments(spark, str(tmp_path)).collect()}
    want = {}
    for t in TOKENS:
        # the longest last syllable that leaves a valid rest, and so on
        best = max(cuts(t), key=lambda c: [len(x) for x in c], default=[])[::-1]
        want[t] = (bool(best), len(best), " ".join(best))
    assert got == want and got["shuangzhuangchuang"] == (True, 3, "shuang zhuang chuang")
