"""Abusive, hateful or sexually explicit texts: boosted trees over dense features, calibrated.

Every document gets the same features, whether or not a word of a lexicon occurs in it: those of its most
suspicious sentence (densities of general lexicons by what they tell, how near the second person stands,
quotation, the author's own person, words of neutral mention, punctuation, how much had to be undone before
words could be read) and of the whole text (capitals, disguises, and a lexicon learned from labels:
character n-grams weighted by their log-odds in labelled documents). Gradient-boosted trees start from a
prior margin and are fitted to a bounded sample of labels; isotonic regression calibrates them on
held-out folds, for which the learned lexicon comes from the other folds too.

The lexicons are general vocabulary. What is particular to a corpus is learned from its labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .vec import code_points, rolling_hashes, slices

#: Most labelled documents that are fitted, the ones of smallest hash of doc_id.
MAX_LABELS = 20_000
#: Most n-grams of the learned lexicon that are weighed, the most frequent ones of positive documents.
VOCABULARY = 1 << 16
#: Lengths of the n-grams of the learned lexicon, and slots of its lookup table.
GRAMS, SLOTS = (2, 3, 5), 20
FOLDS = 5
#: A document is found if its calibrated score is at least this.
THRESHOLD = 0.5

# Word lists of general vocabulary by what the words tell; matched after disguises are undone.
INSULT = (
    "バカ ばか 馬鹿 アホ あほ 阿呆 ボケ クズ カス ゲス 下衆 ザコ 雑魚 ゴミ 生ゴミ 粗大ゴミ 能なし 能無し 無能 間抜け まぬけ マヌケ ノロマ のろま たわけ 低能 ブス 汚物 クソ くそ 糞 野郎 役立たず 恥さらし 恥知らず 目障り "
    "腰抜け 卑怯者 ろくでなし 人でなし キモい きもい ウザい うざい うぜえ 吐き気 売女 頭の悪い 頭が悪い "
    "idiot idiotic moron moronic imbecile dumbass dumb loser scumbag scum bastard asshole arsehole bitch stupid retard retarded jackass pathetic worthless trash filth filthy garbage crap shit bullshit "
    "jerk prick dickhead twat wanker cretin dimwit halfwit nitwit lowlife degenerate whore slut cunt fucker motherfucker disgusting vile swine miserable "
    "vollidiot idiot drecksack trottel arschloch dreck müll mist abschaum dummkopf schwachkopf versager wichser hurensohn schlampe fotze blödmann depp missgeburt mistkerl miststück schwein "
    "crétin imbécile idiot salaud salope connard connasse ordure merde abruti débile enculé pute bouffon raclure minable "
    "idiota imbécil estúpido gilipollas cabrón puta mierda basura escoria pendejo stronzo bastardo merda cretino babaca otário "
    "идиот дурак тварь мразь ублюдок сука урод дебил ничтожество мусор "
    "蠢货 人渣 白痴 傻逼 废物 垃圾 狗屎 混蛋 笨蛋 王八蛋 贱人 畜生 败类 蠢猪 脑残 "
    "멍청이 멍청한 바보 쓰레기 오물 병신 머저리 개새끼 등신 찌질이 미친놈 한심한 "
    "โง่ ไอ้ ขยะ เลว ควาย สารเลว ชั่ว เหี้ย สวะ "
    "मूर्ख बेवकूफ कचरा गधा गधे कमीना कमीने हरामी कुत्ता कुत्ते नालायक घटिया"
).split()
THREAT = [
    *"死ね 氏ね 消えろ 失せろ くたばれ 殺す 殺して 殺される ぶっ殺 黙れ だまれ 呪われろ 地獄に落ちろ 首を吊れ".split(),
    *"shut up;drop dead;die alone;kill yourself;kill you;get lost;rot in hell;burn in hell;go to hell;hope you die;choke on;piss off;fuck off;watch your back;beat you".split(";"),
    *"halt die klappe;halt's maul;verschwinde;verpiss dich;verrecke;stirb;krepier;zur hölle;bring dich um".split(";"),
    *"ferme-la;ferme ta gueule;ta gueule;va crever;crève;dégage;va mourir;je vais te tuer".split(";"),
    *"cállate;muérete;vete al infierno;te voy a matar;заткнись;сдохни;умри;убью".split(";"),
    *"去死 闭嘴 滚吧 滚开 滚蛋 不配 找死 杀了你 닥쳐 뒈져 꺼져 죽어 죽여 ไปตาย หุบปาก ไสหัวไป".split(),
    *"मर जा;चुप कर;दफ़ा हो;भाग यहाँ से".split(";"),
]
DEHUMANISE = [
    *"下等 汚らわしい 害虫 寄生虫 ゴキブリ 虫けら 蛆虫 皆殺し 根絶やし 劣等 追い出せ 叩き出せ 出て行け 人間じゃない 生まれつき".split(),
    *"vermin;subhuman;parasites;cockroaches;inferior race;inferior breed;savages;exterminate;wipe them out;drive them out;driven out;deserve to die;not human;go back to your country".split(";"),
    *"ungeziefer;untermenschen;minderwertig;parasiten;ausrotten;vertreiben;abschieben;la vermine;sous-hommes;race inférieure;parasites;les exterminer;les chasser".split(";"),
    *"害虫 蝗虫 赶出去 滚出去 劣等 低等 低劣 灭绝 해충 벌레만도 쫓아내 열등 기생충 แมลงสาบ कीड़े".split(),
]
SEXUAL = [
    *"全裸 裸の 乳房 おっぱい 喘ぎ 腰を振 交わり 交わった 無修正 エロ エロい エッチ 丸見え 下着 口づけ 脱いだ 服を脱 自撮り 性交 中出し フェラ 巨乳 セックス 勃起 射精".split(),
    *"naked;nude;nudes;nude pics;uncensored;porn;blowjob;bare breasts;tits;boobs;screwed;fucked;moaned;moaning;undressed;horny;orgasm;cumshot;sex tape;hardcore sex;sweaty".split(";"),
    *"unzensiert;unzensierte;geile;nackt;nackte;nacktbilder;ficken;titten;filles nues;sans censure;seins nus;baise;jouir;bite;desnuda;tetas;follar;porno".split(";"),
    *"无码 裸体 裸照 呻吟 做爱 淫 性爱 누드 무수정 알몸 야동 신음 섹스 노출 เปลือย โป๊ หนังโป๊ नंगी अश्लील".split(),
]
SECOND = [
    *"お前 おまえ てめえ てめー 貴様 きさま あんた おめえ こいつ そいつ あいつ やつら 奴ら お前ら 筆者".split(),
    *"you;your;yours;u;ur;yourself;you're;du;dein;deine;deinen;dich;dir;ihr;euch;tu;ton;ta;tes;toi;vous;espèce de;tú;tu;eres;usted;ты;тебя;твой;вы".split(";"),
    *"你 你们 您 너 너는 네 니 너희 당신 तू तुम तेरा तेरी มึง แก พวกแก".split(),
]
SELF = [
    *"自分 我ながら 私は 私が 俺は 俺って 僕は 私って わたしは うちの".split(),
    *"i;i'm;i am;i was;i felt;me;my;myself;ich;ich bin;mich;mein;mir;je;j'ai;je me;moi;mon;yo;soy;я;меня".split(";"),
    *"我 我自己 我真 나는 내가 나도 제가 ฉัน ผม मैं मुझे".split(),
]
CONTEXT = [
    *"辞書 辞典 意味 語源 単語 用語 言葉 文献 論文 報告 報道 記事 新聞 研究 調査 講義 授業 博物館 美術館 展示 展覧 画家 彫刻 小説 映画 作品 医療 医師 診察 診断 検診 患者 手術 治療 料理 食材 野菜 品種 飼育 動物 植物 昆虫 農 通報 規約 規定 禁止 違反 削除 審査 方針 引用 処理 装置 機械 分別 回収".split(),
    *"dictionary;word;term;phrase;meaning;means;etymology;museum;gallery;exhibition;painting;painter;sculpture;novel;film;poem;report;reported;article;newspaper;study;research;lecture;course;policy;rules;moderator;moderators;moderation;removed;banned;quoted;quotes;according to;wrote;patient;doctor;medical;clinical;screening;anatomy;recipe;cook;breed;species;animal;garden;farm;process;thread;server;recycling;bin".split(";"),
    *"wörterbuch;wort;begriff;bedeutung;museum;ausstellung;gemälde;roman;film;bericht;artikel;zeitung;studie;forschung;seminar;regeln;moderation;moderator;patient;arzt;medizinisch;rezept;tier;prozess;dictionnaire;mot;terme;sens;musée;exposition;tableau;roman;rapport;article;journal;étude;recherche;cours;règles;modération;modérateur;patient;médecin;recette;animal;processus".split(";"),
    *"词典 字典 意思 词语 博物馆 展览 画作 小说 电影 报告 报道 研究 课程 规定 审核 删除 医生 患者 检查 食谱 品种 动物 进程 사전 단어 뜻 의미 박물관 전시 소설 영화 보고 기사 연구 수업 규정 운영 삭제 의사 환자 검진 요리 품종 동물 พจนานุกรม คำว่า ความหมาย พิพิธภัณฑ์ นิทรรศการ รายงาน วิจัย แพทย์ ผู้ป่วย शब्दकोश शब्द अर्थ संग्रहालय प्रदर्शनी रिपोर्ट शोध डॉक्टर रोगी".split(),
]
HOT = {"insult": INSULT, "threat": THREAT, "dehumanise": DEHUMANISE, "sexual": SEXUAL}
_LEET = str.maketrans("0134578$@!€", "oieastbsaie")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u034f\u180e]")
_ACCENTED = re.compile("[\u00e0-\u00ff\u0300-\u036f]")
_ACCENTS = re.compile("[\u0300-\u036f]")
_CROSS_SCRIPT = re.compile("[a-z][\u0370-\u03ff\u0400-\u04ff]|[\u0370-\u03ff\u0400-\u04ff][a-z]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W_][ .·・*_-]{1,3}){2,}[^\W_](?![^\W_])")
_CJK = "ぁ-んァ-ヶ一-鿿"
_CJK_GAP = re.compile(rf"[ 　・.·*_-](?<=[{_CJK}].)[ 　・.·*_-]*(?=[{_CJK}])")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_LEET_WORD = re.compile(r"[0134578$@€][a-z][a-z0-9$@!€]*|[a-z]+[0134578$@!€]+[a-z][a-z0-9$@!€]*|[a-z]{2,}[0134$@€](?![0-9a-z])")
MASKS = "*○〇●×✕＊"
_MASK = re.compile(rf"[^\W_]*[{MASKS}][^\s、。,.!?]*")
_DROP = re.compile("[ .·・*_-]")
FEATURES = (
    "insult threat dehumanise sexual masked second near self context quoted exclaim size hot_density learned learned_next undone capitals hot_sentences prior"
).split()
PRIOR = FEATURES.index("prior")


def _folded(text: str) -> str:
    """A word or text in the form that lexicons are compared in."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold().replace("’", "'")
    if _ACCENTED.search(t):
        t = unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", t)))
    return t


def undone(text: str) -> tuple[str, int]:
    """A text with disguises undone (look-alikes, gaps, repeats, digits for letters), and how many there were."""
    t = _folded(text)
    count = 0
    if not text.isascii():
        count = len(_INVISIBLE.findall(text))
        if _CROSS_SCRIPT.search(t):
            from .confusables import unify

            plain = unify(t).casefold()
            count += plain != t
            t = plain
        t, n = _CJK_GAP.subn("", t)
        count += n
    for pattern, to in ((_SPACED, lambda m: _DROP.sub("", m[0])), (_REPEAT, r"\1")):
        t, n = pattern.subn(to, t)
        count += n
    t, n = _LEET_WORD.subn(lambda m: m[0].translate(_LEET), t)
    return t, count + n


def _pattern(words: list[str]) -> re.Pattern:
    """Words of alphabets match as whole words, Hangul from a word's start, katakana as whole runs, others anywhere."""
    out = []
    for w in sorted({_folded(w) for w in words}, key=len, reverse=True):
        if re.match("[a-zßа-я]", w):
            out.append(r"(?<![^\W\d_])" + re.escape(w) + r"(?![^\W\d_])")
        elif re.fullmatch("[ァ-ヶー]+", w):
            out.append(f"(?<![ァ-ヶー]){w}(?![ァ-ヶー])")
        else:
            out.append(("(?<![가-힣])" if "가" <= w[0] <= "힣" else "") + re.escape(w))
    return re.compile("|".join(out))


_SIDE = {k: _pattern(v) for k, v in (("second", SECOND), ("self", SELF), ("context", CONTEXT))}
_MASKABLE = [w for w in {_folded(w) for w in (*INSULT, *THREAT)} if " " not in w]
_MASKED_CJK = re.compile("|".join(f"{re.escape(w[:i])}[{MASKS}]{re.escape(w[i + 1 :])}" for w in sorted(_MASKABLE) if not re.match("[a-zа-я]", w) and 2 <= len(w) <= 4 for i in range(len(w))))
_TERMS: dict[str, object] = {}


def _terms():
    """Aho-Corasick automaton of the hot words, built once in each worker: (category, length, alphabet, katakana)."""
    if "all" not in _TERMS:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for k, words in enumerate(HOT.values()):
            for w in map(_folded, words):
                terms.add_word(w, (k, len(w), bool(re.match("[a-zßа-я]", w)), bool(re.fullmatch("[ァ-ヶー]+", w))))
        terms.make_automaton()
        _TERMS["all"] = terms
    return _TERMS["all"]


def _hits(text: str) -> list[tuple[int, int, int]]:
    """(place, end, category) of the hot words of a text that stand at word borders where their script has them."""
    out = []
    for end, (k, n, alphabet, katakana) in _terms().iter(text):
        a, b = end - n + 1, end + 1
        if alphabet and (a and text[a - 1].isalpha() or b < len(text) and text[b].isalpha()):
            continue
        if katakana and (a and "ァ" <= text[a - 1] <= "ー" or b < len(text) and "ァ" <= text[b] <= "ー"):
            continue
        out.append((a, b, k))
    return out


def _masked(sentence: str) -> int:
    """Words with letters masked that fit a word of the lexicons."""
    hits = 0
    for m in _MASK.finditer(sentence):
        shown = [c for c in m[0] if c not in MASKS]
        if re.match("[a-z]", m[0]) and len(shown) >= 2:
            shape = re.compile("".join("." if c in MASKS else re.escape(c) for c in m[0]))
            hits += any(shape.fullmatch(w) for w in _MASKABLE)
    return hits or int(bool(_MASKED_CJK.search(sentence)))


class Learned:
    """Weights of n-grams by hash: a lookup table of fixed size that holds each slot's hash beside its weight."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        self.hash = np.zeros(1 << SLOTS, dtype=np.uint64)
        self.weight = np.zeros(1 << SLOTS, dtype=np.float32)
        order = np.argsort(np.abs(weights), kind="stable")  # in a shared slot the heavier one stays
        slot = (hashes[order] >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.hash[slot], self.weight[slot] = hashes[order], weights[order]

    def weights(self, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of the n-grams that have one."""
        h = rolling_hashes(flat, n)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        w = self.weight[slot]
        at = np.flatnonzero(w)
        at = at[self.hash[slot[at]] == h[at]]
        return at, w[at]


def _revived(kind: type, state: dict):
    out = kind.__new__(kind)
    vars(out).update(state)
    return out


def log_odds(positive: np.ndarray, negative: np.ndarray, n_positive: float, n_negative: float) -> np.ndarray:
    """Smoothed log-odds of n-grams by counts of documents, small ones drawn to zero; below one no weight."""
    w = np.log((positive + 0.5) / (n_positive + 1)) - np.log((negative + 0.5) / (n_negative + 1))
    w = w * (positive + negative) / (positive + negative + 2.0)
    return np.where((np.abs(w) >= 1) & (positive + negative >= 2), np.clip(w, -4, 4), 0).astype(np.float32)


_ENDERS = np.array(sorted(map(ord, "。！？!?．।\n")), dtype=np.uint32)


def _sentence_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which sentences begin: after end marks (a point only before a space), and at each text's start."""
    new = np.zeros(len(flat) + 1, dtype=bool)
    end = np.isin(flat, _ENDERS)
    if len(flat) > 1:
        end[:-1] &= ~end[1:]  # a run of marks ends one sentence
        end[:-1] |= (flat[:-1] == 46) & (flat[1:] == 32)
    new[1:] = end
    new[offsets] = True
    return np.flatnonzero(new[:-1])


def features(texts: list[str | None], learned: Learned) -> np.ndarray:
    """Features of documents, one row each; null and empty texts have the features of no words at all."""
    both = [undone(t) if t else ("", 0) for t in texts]
    plain = [t for t, _ in both]
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, PRIOR] = -5.0
    flat, offsets = code_points(plain)
    if not len(flat):
        return out
    starts = _sentence_starts(flat, offsets)
    sums = np.zeros(len(starts))
    for n in GRAMS:
        at, w = learned.weights(flat, n)
        inside = at + n <= offsets[np.searchsorted(offsets, at, side="right")]
        sums += np.bincount(np.searchsorted(starts, at[inside], side="right") - 1, weights=w[inside], minlength=len(starts))
    size = np.diff(np.append(starts, len(flat)))
    sums /= np.sqrt(np.maximum(size, 12))
    hot = np.zeros(len(starts))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, t in enumerate(plain):
        for a, b, k in _hits(t):
            s = int(np.searchsorted(starts, offsets[i] + a, side="right")) - 1
            hot[s] += 1
            found.setdefault(s, []).append((int(offsets[i]) + a, int(offsets[i]) + b, k))
        if any(c in t for c in MASKS):
            for m in _MASK.finditer(t):
                s = int(np.searchsorted(starts, offsets[i] + m.start(), side="right")) - 1
                hot[s] += 0.5 * (_masked(t[max(0, m.start() - 3) : m.end() + 3]) > 0)
    shouts = np.bincount(np.searchsorted(starts, np.flatnonzero(flat == 33), side="right") - 1, minlength=len(starts))
    base = sums + 1.5 * np.minimum(hot, 2) + 0.1 * np.minimum(shouts, 3)
    first = np.searchsorted(starts, offsets)
    for i, t in enumerate(plain):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        best = a + int(base[a:b].argmax())
        lo = int(starts[best])
        s = t[lo - int(offsets[i]) : lo + int(size[best]) - int(offsets[i])]
        words = found.get(best, [])
        n = [sum(k == c for _, _, k in words) for c in range(4)]
        masked = _masked(s) if any(c in s for c in MASKS) else 0
        seconds = [m.start() for m in _SIDE["second"].finditer(s)]
        own, neutral = len(_SIDE["self"].findall(s)), len(_SIDE["context"].findall(s))
        spot = words[0][0] - lo if words else None
        near = 1 / (1 + min((abs(x - spot) for x in seconds), default=400) / 10) if spot is not None else 0.0
        quoted = 0
        if spot is not None:
            before = s[:spot]
            quoted = int(sum(map(before.count, "「『“„«")) > sum(map(before.count, "」』”»")) or before.count('"') % 2 == 1)
        others = np.sort(sums[a:b])[-2:]
        total = sum(n) + masked
        original = texts[i] or ""
        letters = sum(map(str.isalpha, original)) if not s.isascii() else len(re.findall("[A-Za-z]", original))
        capitals = len(re.findall("[A-Z]", original)) / max(1, letters)
        prior = 1.7 * min(total, 2) + 0.8 * bool(seconds) - 1.6 * min(neutral, 2) - 1.2 * quoted - 0.8 * bool(own) - 3.0
        out[i] = [
            *n, masked, len(seconds), near, own, neutral, quoted, s.count("!") + s.count("！"), len(s), total / max(8, len(s)), sums[best], others[0] if len(others) > 1 else 0.0,
            both[i][1], capitals, int((hot[a:b] > 0).sum()), prior if total else -4.0,
        ]
    return out


class Boosted:
    """Gradient-boosted trees for binary labels, from a prior margin, with isotonic calibration."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 3.0, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[dict] = []
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> dict | float:
        value = -g[rows].sum() / (h[rows].sum() + self.ridge)
        if not depth or h[rows].sum() < 2 * self.least * 0.25:
            return float(value)
        best = (1e-6, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
        for c in range(x.shape[1]):
            col = x[rows, c]
            order = np.argsort(col, kind="stable")
            gs, hs = np.cumsum(g[rows][order]), np.cumsum(h[rows][order])
            cut = np.flatnonzero(col[order][1:] > col[order][:-1])
            if not len(cut):
                continue
            gl, hl = gs[cut], hs[cut]
            gr, hr = gs[-1] - gl, hs[-1] - hl
            gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - total
            n = cut + 1
            gain[(n < self.least) | (len(rows) - n < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], c, float((col[order][cut[k]] + col[order][cut[k] + 1]) / 2))
        if best[1] is None:
            return float(value)
        left = x[rows, best[1]] <= best[2]
        return {"c": best[1], "t": best[2], "l": self._grow(x, g, h, rows[left], depth - 1), "r": self._grow(x, g, h, rows[~left], depth - 1)}

    def _walk(self, tree: dict | float, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, dict):
            return np.full(len(x), tree)
        out = np.empty(len(x))
        left = x[:, tree["c"]] <= tree["t"]
        out[left], out[~left] = self._walk(tree["l"], x[left]), self._walk(tree["r"], x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = x[:, PRIOR].astype(float).copy()
        for tree in self.trees:
            out += self.rate * self._walk(tree, x)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-self.margin(x)))
            self.trees.append(self._grow(x, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), self.depth))
        return self

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> Boosted:
        """Isotonic regression of labels on margins by pooling neighbours that violate the order."""
        at, row = np.unique(margin, return_inverse=True)  # equal margins are one pool
        pools: list[list[float]] = []
        for m, positive, rows in zip(at, np.bincount(row, weights=y), np.bincount(row)):
            pools.append([float(positive), float(rows), float(m)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n, m2 = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, m2]
        self.steps = (np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if len(self.steps[0]) < 2:
            return 1 / (1 + np.exp(-m))
        return np.interp(m, *self.steps)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Boosted:
    """Trees on all rows, calibrated on margins of held-out folds. Without both labels the prior alone scores."""
    if len(set(y.tolist())) < 2:
        return Boosted()
    held = np.zeros(len(y))
    for k in range(FOLDS):
        held[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Boosted().fit(x, y).calibrate(held, y)


def label_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """(doc_id, text, toxic, fold): documents by the majority of their labels; null labels, ties and unknown ids are left out."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("mean")).where("mean <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", (F.col("mean") > 0.5).cast("int").alias("toxic"))
    known = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))


def _gram_ids(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's n-grams, with disguises undone."""
    flat, _ = code_points([undone(text)[0] if text else ""])
    return np.unique(np.concatenate([rolling_hashes(flat, n) for n in GRAMS]))


def learned_lexicons(sample: DataFrame) -> list[Learned]:
    """A lexicon for each fold, from the other folds, and one from all.

    The n-grams weighed are the ``VOCABULARY`` most frequent ones that occur in two positive documents at
    least. What comes to the driver is their counts, of bounded size.
    """

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_gram_ids(t).view(np.int64))], names=["h"])

    frequent = sample.where("toxic = 1").select("text").mapInArrow(positive, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(VOCABULARY)
    vocabulary = np.sort(np.array(frequent.select("h").toArrow().column("h").to_numpy(), dtype=np.int64).view(np.uint64))
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros((FOLDS, 2, len(words) + 1), dtype=np.int32)  # at the end the number of documents
        for batch in batches:
            for t, y, k in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                ids = _gram_ids(t)
                at = np.searchsorted(words, ids)
                at[at == len(words)] = 0
                total[k, y, at[words[at] == ids] if len(words) else []] += 1
                total[k, y, -1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    rows = sample.select("text", "toxic", "fold").coalesce(8).mapInArrow(counted, "counts binary").collect()  # eight rows of fixed size
    counts = sum((np.frombuffer(r["counts"], dtype=np.int32).reshape(FOLDS, 2, -1) for r in rows), np.zeros((FOLDS, 2, len(vocabulary) + 1), dtype=np.int64))
    out = []
    for k in range(FOLDS + 1):
        negative, pos = counts[[f for f in range(FOLDS) if f != k]].sum(0)
        out.append(Learned(vocabulary, log_odds(pos[:-1], negative[:-1], pos[-1], negative[-1])))
    return out


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> tuple[Boosted, Learned]:
    """A model from at most ``most`` labelled documents; their features, not texts, come to the driver."""
    sample = runtime.materialize(label_sample(documents, labels, most), "labelled")
    lexicons = learned_lexicons(sample)
    shared = sample.sparkSession.sparkContext.broadcast([vars(x) for x in lexicons[:FOLDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_revived(Learned, state) for state in shared.value]
        for batch in batches:
            for k in range(FOLDS):
                own = batch.filter(pa.array(batch.column("fold").to_numpy() == k))
                if own.num_rows:
                    x = features(own.column("text").to_pylist(), held[k])
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), own.column("fold"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "f"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, fold int, f array<double>").toArrow().sort_by("doc_id").to_pydict()
    runtime.drop(sample)
    model = fit(np.array(rows["f"], dtype=float).reshape(-1, len(FEATURES)), np.array(rows["toxic"], dtype=float), np.array(rows["fold"], dtype=int))
    return model, lexicons[FOLDS]


def scored(documents: DataFrame, model: tuple[Boosted, Learned]) -> DataFrame:
    """(doc_id, source, score): null and empty texts score as texts without words."""
    shared = documents.sparkSession.sparkContext.broadcast([vars(part) for part in model])  # plain values: executors need no package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, learned = (_revived(kind, state) for kind, state in zip((Boosted, Learned), shared.value))
        for batch in slices(batches, "text"):
            x = features(batch.column("text").to_pylist(), learned)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(trees.score(x), pa.float64())], names=["doc_id", "source", "score"])

    return runtime.spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id long, source string, score double")


def _tables(spark, folder: str) -> tuple[DataFrame, tuple[Boosted, Learned]]:
    documents = runtime.table(spark, folder, "documents")
    return documents, train(documents, runtime.table(spark, folder, "labels"))


def p9_found(spark, folder: str) -> DataFrame:
    """(doc_id): documents whose author insults, threatens or degrades, or is sexually explicit."""
    documents, model = _tables(spark, folder)
    return scored(documents, model).where(F.col("score") >= THRESHOLD).where("doc_id is not null").select("doc_id").distinct()


def p9_rates(spark, folder: str) -> DataFrame:
    """(source, documents, found, mean_score) per source; repeated rows of a document count once."""
    documents, model = _tables(spark, folder)
    one = scored(documents, model).groupBy("doc_id", "source").agg(F.max("score").alias("score"))
    return one.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("found"), F.avg("score").alias("mean_score"))
