"""Words of Japanese and Chinese text as the cheapest path through a dictionary lattice.

Every dictionary word is an edge, and so is every short run of one script as an unknown
word; the path of the least total cost gives the words and their classes.
"""

from __future__ import annotations

import re
from itertools import product

# --- fixed values -------------------------------------------------------------
#: Particles that join what follows to what stands before them; after a full stop they are none if a comma follows.
_JA_JOIN = "という といった といい として とある との とは とも とか って と は が を に の も で へ から まで より や など なんて なる ような ように について による によれば"
#: Words that begin a sentence although they begin like a particle, or hold one, and common words of texts.
_JA_OTHER = (
    "はじめ はじめに はじめて はい はず はたして はるか はやく はっきり がんばれ がっかり にわか にぎやか のち のちに のぼる のんびり もし もしも もちろん もっと もっとも もう もはや もともと もの "
    "でも では ですから できる できれば でかける とても ところ ところが ところで とにかく ともかく とうとう とりわけ ときどき とき とくに ともに となり どうして からだ から回り かつて かつ までに よりよい より多く やがて やはり "
    "やっと やさしい へや へいわ しかし そして それから それ それで それでも また または さらに だが だから なお なぜ なぜなら つまり たとえば すると ただし あるいは この その あの どの これ あれ ここ そこ あそこ "
    "こと ため よう さん くん ちゃん など 今 今日 昨日 明日 人 人々 町 村 橋 塔 井戸 屋根 家 川 山 年 月 日 時 世紀 巻 戸 彼女たち"
)
_JA_PRONOUN = "彼 彼女 彼ら 私 僕 俺 我々 誰 母 父 兄 姉 妹 弟 先生 男 女 子供 少年 少女 著者 作者"
_JA_FINAL = "か よ ね ぞ ぜ さ わ な です ます でした ました だ だった である であった た いる いた ある あった ない なかった する した なった ください だろう でしょう"
#: Verbs of saying: stems with the endings of their forms.
_JA_SAY = (
    ("言 いい", "った う っている っていた っていたという いました います い放った い残した"), ("書 叫 呟 つぶや ささや 囁 嘆 泣 聞 説", "いた く いている いていた きました きます いてある んだ んでいる びました"),
    ("述べ 答え 尋ね 告げ 訴え 伝え 付け加え", "た る ている ていた ました ます"), ("語 怒鳴 笑", "った る っている っていた りました います った"), ("話 記 返 話し出", "した す している していた しました"),
    ("呼", "んだ ぶ んでいる びました"), ("指摘 主張 質問 説明 回答 発言 返事 宣言 反論 報告", "した する している していた しました"),
)
_ZH_SAY = (
    "说 說 问 問 答 喊 叫 曰 写道 寫道 说道 說道 问道 問道 答道 喊道 叫道 叹道 嘆道 笑道 怒道 骂道 罵道 回道 应道 應道 低声道 称道 记载道 评论道 补充道 解释道 "
    "指出 表示 回答 认为 認為 补充 補充 解释 解釋 宣布 宣称 宣稱 强调 強調 写到 寫到 提到 感叹 感嘆 喃喃自语 告诉 告訴 反驳 追问 呼喊 大喊 大叫 记载 記載 声称 聲稱 说过 说着 補充說 补充说"
)
#: Verbs of saying of one character that other words often end with.
_ZH_RARE_SAY = "道 称 稱 云"
_ZH_JOIN = "的 地 得 着 之 等 等等 这样的 這樣的 这句话 這句話 这话 這話 一句 一语 一語 一词 一詞 几个字 幾個字 并 並 并且"
_ZH_PRONOUN = "他 她 它 他们 她们 他們 她們 我 我们 我們 你 你们 人们 人們 老师 老師 母亲 父亲 大家 有人 作者"
_ZH_AFTER = "了 过 過 着 著"
_ZH_OTHER = (
    "据说 據說 小说 小說 传说 傳說 听说 聽說 学说 學說 演说 演說 解说 虽说 再说 按说 俗话说 俗話說 街道 知道 轨道 軌道 隧道 道路 道理 铁道 鐵道 频道 頻道 管道 通道 渠道 味道 报道 報道 人行道 "
    "河道 航道 国道 古道 神道 楼道 难道 地道 公道 名称 名稱 简称 簡稱 人称 人稱 对称 對稱 全称 别称 统称 俗称 号称 职称 白云 白雲 乌云 烏雲 风云 星云 问答 学问 疑问 提问 访问 顾问 请问 学问 回答者 "
    "名叫 答案 地方 地区 地區 地上 地下 地面 地理 地图 地圖 地位 地点 地址 地铁 地震 地主 得到 得知 目的 的确 的士 等级 等待 等到 等于 着火 着手 之后 之後 之前 之间 之外 并非 并不 并没有 並非 "
    "在 于 於 对 對 向 从 從 和 与 與 是 有 被 把 大声 大聲 低声 低聲 轻声 然后 然後 但是 因此 所以 如果 博物馆 博物館 该 該 塔 高 米 年 月 日 桥 橋 屋顶 谁 誰 付 冬天 水 冲走 走 来 去 离开 離開 站 起来 不 没有 也 都 又 再 还 "
    "这 這 那 这个 那个 这里 那里 后来 後來 于是 於是 一 个 人 据 據 版本"
)
#: Costs of a dictionary word, of a rare reading, and of the first and each further character of an unknown word; characters of the longest.
_KNOWN, _RARE, _NEW, _FURTHER, _LONGEST = 1.8, 3.0, 3.0, 2.2, 6
# -------------------------------------------------------------------------------

_RUN = re.compile(r"[ァ-ヿ]+|[A-Za-z]+|[0-9０-９.,]+|\s+")


def _dictionary(*classes: tuple[str, str, float]) -> dict[str, tuple[str, float]]:
    return {w: (name, cost) for words, name, cost in classes for w in words.split()}


JAPANESE = _dictionary((_JA_FINAL, "final", _KNOWN), (_JA_JOIN, "join", _KNOWN), (_JA_PRONOUN, "person", _KNOWN), (_JA_OTHER, "word", _KNOWN)) | {
    a + b: ("say", _KNOWN) for stems, ends in _JA_SAY for a, b in product(stems.split(), ends.split())
}
CHINESE = _dictionary(
    (_ZH_AFTER, "after", _KNOWN), (_ZH_SAY, "say", _KNOWN), (_ZH_RARE_SAY, "say", _RARE), (_ZH_PRONOUN, "person", _KNOWN), (_ZH_JOIN, "join", _KNOWN), (_ZH_OTHER, "word", _KNOWN)
)
_WIDTH = {id(d): max(map(len, d)) for d in (JAPANESE, CHINESE)}


def _script(ch: str) -> str:
    return "kana" if "぀" <= ch <= "ゟ" else "han" if ch.isalpha() else ch


def segment(text: str, dictionary: dict[str, tuple[str, float]]) -> list[tuple[str, str]]:
    """(word, class) of the cheapest path; the class of an unknown word is ''. Of equal paths the one with the longer last words."""
    n, width = len(text), _WIDTH[id(dictionary)]
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(float("inf"), 0, "")] * n
    for i in range(n):
        at = best[i][0]
        run = _RUN.match(text, i)
        edges = [(run.end(), _NEW, "")] if run else []
        script = _script(text[i])
        for j in range(i + 1, min(n, i + _LONGEST) + 1):
            if _script(text[j - 1]) != script:
                break
            edges.append((j, _NEW + _FURTHER * (j - i - 1), ""))
        for j in range(i + 1, min(n, i + width) + 1):
            known = dictionary.get(text[i:j])
            if known:
                edges.append((j, known[1], known[0]))
        for j, cost, name in edges:
            if at + cost < best[j][0]:
                best[j] = (at + cost, i, name)
    out = []
    while n:
        _, i, name = best[n]
        out.append((text[i:n], name))
        n = i
    return out[::-1]
