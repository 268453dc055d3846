"""Token channels over a token table: keys, tok_idx, surface, pos, base, masked, from a pluggable analyzer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "struct<surface:string,pos:string,base:string,start:int,end:int>"
# Parts of speech by role, and closed lists of lemmas.
FUNCTION = ("助詞", "助動詞", "接続詞")
CLOSED = (*FUNCTION, "代名詞", "連体詞", "感動詞")
SKIPPED = ("空白", "補助記号", "記号")
FORMAL_NOUNS = ("こと", "もの", "ため", "わけ", "はず")
FIRST_PERSON = "自分 私 僕 俺 わたし ぼく おれ 我々 私たち 僕ら 自分たち われわれ 当方 筆者".split()


def script_analyzer(sentence: str) -> list[dict]:
    """Tokens by runs of script, without parts of speech: the default where no tagger is installed."""
    import re

    runs = re.finditer("[一-鿿㐀-䶿々]+|[ぁ-ゟ]+|[ァ-ヿ]+|[A-Za-z]+|[0-9]+", sentence)
    return [{"surface": m[0], "pos": None, "base": m[0], "start": m.start(), "end": m.end()} for m in runs]


def tokenized(sentences: DataFrame, keys: list[str], analyzer: Callable[[str], list[dict]] = script_analyzer) -> DataFrame:
    """keys, tok_idx, surface, pos, base, start, end of sentences; the analyzer runs once a sentence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("surface", pa.string()), ("pos", pa.string()), ("base", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            yield b.append_column("t", pa.array([analyzer(s) if s else [] for s in b.column("sentence").to_pylist()], kind))

    slim = sentences.select(*keys, "sentence")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + f", t array<{TOKEN}>"
    return slim.mapInArrow(run, schema).select(*keys, F.posexplode("t").alias("tok_idx", "t")).select(*keys, "tok_idx", "t.*")


#: A sentence's tokens by rule: closed lists first, then runs of script.
RULE_TOKEN = (
    "[一-鿿㐀-䶿々]+|しかし|そして|また|こと|もの|ため|わけ|はず|この|その|あの|これ|それ|ました|でした|ません|です|ます|ない|から|まで|だ|た|[はがをにでともへやの]|[ぁ-ゟ]|[ァ-ヿ]+|[A-Za-z]+|[0-9]+|[、，]|[。！？!?]"
)
#: Part of speech, detail and words of the closed lists of the rules; other kana are verbs, other runs nouns.
RULE_WORDS = [
    ("接続詞", "*", "しかし そして また"),
    ("名詞", "普通名詞", "こと もの ため わけ はず"),
    ("連体詞", "*", "この その あの"),
    ("代名詞", "*", "これ それ 私 僕 俺 自分"),
    ("助動詞", "*", "ました でした ません です ます ない だ た"),
    ("助詞", "格助詞", "から まで は が を に で と も へ や の"),
    ("補助記号", "読点", "、 ，"),
    ("補助記号", "句点", "。 ！ ？ ! ?"),
]


def rule_tokens(sentences: DataFrame, keys: list[str], placeholder: str = "識別子") -> DataFrame:
    """keys, sent_idx, para, tok_idx, surface, pos, pos_detail, base, cform, masked of sentences(keys, sent_idx, para, sentence).

    A stand-in for a tagger, all built-ins: tokens by closed lists and runs of script. It makes every channel
    computable where no tagger is installed; its parts of speech are no linguistic analysis.
    """
    t = sentences.select(*keys, "sent_idx", "para", F.posexplode(F.regexp_extract_all("sentence", F.lit(RULE_TOKEN), F.lit(0))).alias("tok_idx", "surface"))
    pos, detail = F.when(F.col("surface").rlike("^[ぁ-ゟ]$"), "動詞").otherwise("名詞"), F.lit("普通名詞")
    for name, kind, words in reversed(RULE_WORDS):
        known = F.col("surface").isin(*words.split())
        pos, detail = F.when(known, name).otherwise(pos), F.when(known, kind).otherwise(detail)
    return t.select("*", pos.alias("pos"), detail.alias("pos_detail"), F.col("surface").alias("base"), F.lit("*").alias("cform"), (F.col("surface") == placeholder).alias("masked"))
