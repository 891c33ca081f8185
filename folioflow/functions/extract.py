"""Rows out of texts by patterns: references, terms, concepts, categories, key points, headings and forms.

Word boundaries are written out as (^|[^\\p{L}\\p{N}_]) where a pattern needs them, so that every engine
sees the same ones whatever the script.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as X

# References by kind. Without a group the whole match is the label.
REFERENCES = (
    ("figure", r"如图\s*(\d+\.\d+|\d+)"),
    ("figure", r"图\s*(\d+\.\d+|\d+)(?:[\(（].*?[\)）])?\s*(?:所示|显示|展示)"),
    ("figure", r"Figure\s*(\d+\.\d+|\d+)\s*(?:shows|displays|illustrates)"),
    ("figure", r"参见图\s*(\d+\.\d+|\d+)"),
    ("table", r"表\s*(\d+\.\d+|\d+)(?:[\(（].*?[\)）])?"),
    ("table", r"Table\s*(\d+\.\d+|\d+)"),
    ("table", r"如表\s*(\d+\.\d+|\d+)(?:所示|显示)"),
    ("section", r"第\s*[一二三四五六七八九十\d]+\s*章"),
    ("section", r"第\s*[一二三四五六七八九十\d]+\s*节"),
    ("section", r"Section\s*\d+(?:\.\d+)*"),
    ("section", r"Chapter\s*\d+"),
    ("citation", r"参考文献\s*\[([^\]]+)\]"),
    ("citation", r"文献\s*\[([^\]]+)\]"),
    ("citation", r"参考文献\s*\d+(?:\s*,\s*\d+)*"),
    ("citation", r"\[(\d+(?:\s*,\s*\d+)*)\]"),
    ("citation", r"\(([A-Z][a-z]+,\s*\d{4})\)"),
    ("document", r"参见《([^》]{2,50})》"),
    ("document", r"参考《([^》]{2,50})》"),
    ("document", r"详见《([^》]{2,50})》"),
    ("document", r"《([^》]{2,50})》中(?:提到|指出|说明|阐述)"),
    ("document", r"参见文献《([^》]{2,50})》"),
)
# Marks of terms, and what a term's words say of its type.
TERMS = (r"\*\*(.+?)\*\*", r"``(.+?)``", r"《([^》]{2,30})》", r'"([^"]{2,30})"')
TERM_TYPES = (
    ("concept", ("算法", "模型", "理论", "原理", "概念", "定义")),
    ("method", ("方法", "技术", "策略", "方案", "流程", "步骤")),
    ("tool", ("工具", "软件", "系统", "平台", "框架", "库")),
)
# Concepts by type; letters in either case.
CONCEPTS = (
    ("definition", r'(?:定义为|是指|称为|叫做|即|指的是|定义作|Definition|Definition:|define[sd]?|defined as)\s*["]?([^",。；\n]{2,30})["]?'),
    ("definition", r"(\S+)\s*(?:是|指|指的是|就是|即为)\s*"),
    ("example", r'(?:例如|比如|举例|例\d+|例题|示例|Example|Example:|example[s]?|for example|such as|e\.g\.)\s*["]?([^",。；\n]{2,50})["]?'),
    ("example", r"(?:如图\s*\d+|表\s*\d+所示).*?(?:说明|展示|描述了?)\s*([^。；\n]{2,50})"),
    ("application", r'(?:应用|运用|使用|可用于|适用于|应用领域|应用场景|Application|Application:|apply|applications|usage|use case)\s*["]?([^",。；\n]{2,50})["]?'),
    ("application", r"(?:实际应用|实践应用|工程应用|商业应用)\s*(?:中|方面)?[:：]?\s*([^。；\n]{2,50})"),
    ("explanation", r'(?:解释|说明|阐述|详述|Explanation|Explanation:|explain|explanation)\s*["]?([^",。；\n]{2,50})["]?'),
    ("explanation", r"([^。；\n]{2,30})\s*(?:的)?(?:原因|原理|机制|工作原理|工作流程)"),
    ("problem", r"(?:问题|疑问|难点|挑战|Question|Problem|problem[s]?|question[s]?|issue[s]?)\s*[:：]\s*([^。；\n]{2,50})"),
    ("problem", r"(?:思考题|练习题|作业题|习题)\s*[\d\.]+\s*[:：]?\s*([^。；\n]{2,50})"),
)
# Marks of a concept in a line or chunk, in order of precedence; letters in either case. An empty
# alternative among those of examples, which would match everywhere, is left out.
CONCEPT_MARKS = (
    ("definition", r"(?:定义为|是指|称为|叫做|即|指的是|定义为|定义作|定义为|Definition|Definition:|define[sd]?|defined as)"),
    ("example", r"(?:例如|比如|举例|例\d+|例题|示例|例如|比如|Example|Example:|example[s]?|for example|such as|e\.g\.)"),
    ("application", r"(?:应用|运用|使用|可用于|适用于|应用领域|应用场景|Application|Application:|apply|applications|usage|use case)"),
    ("explanation", r"(?:说明|解释|阐释|意思是|意味着|可以理解为|换言之|也就是说|Explanation|Explanation:|explain[s]?|meaning|in other words)"),
    ("summary", r"(?:总结|结论|综上|总而言之|总之|Summary|Summary:|conclusion|in conclusion|to sum up)"),
    ("problem", r"(?:问题|疑问|难点|挑战|Question|Problem|problem[s]?|question[s]?|issue[s]?)"),
)
DEFINED = r"定义为|是指|称为|叫做|即|指的是"
EXERCISE = r"(?i)(?:^|\n)\s*(?:例\s*\d|例题|习题|练习|思考题|作业|课后题|【例】|【题】|【练习】|【思考】|(?:第?\d+[\.、)\)]\s*题)|(?:Exercise|Example|Problem|Question)\s*\d)"
# Categories of statements.
CATEGORIES = {
    "principle": (r"(?s)(?:原理|定理|定律|公理|法则|规律|机制|本质)[是为：:](.{10,200})", r"(?s)(.{4,60}(?:原理|定理|定律|公理|法则|规律))", r"(?:^|\n)\s*(?:定义[：:])\s*(.{10,200})"),
    "why": (r"(?s)(?:原因|因为|由于|之所以|目的|意义)[是为在：:](.{10,200})", r"(?s)(?:为什么|为何|何以).{0,4}(.{10,200})", r"(?s)(.{4,60}(?:的原因|的目的|的意义|的作用))"),
    "how": (r"(?s)(?:方法|步骤|流程|过程|做法|途径|措施)[是为：:](.{10,200})", r"(?s)(?:如何|怎样|怎么).{0,4}(.{10,200})", r"(?s)(?:首先|第一步|步骤\s*\d)(.{10,200})"),
}
# Where documents of a type name their points.
POINTS = {
    "exam": (r"(?i)考点[:：]\s*([^\n]+)", r"(?i)知识点[:：]\s*([^\n]+)"),
    "technical": (r"(?i)API[:：]\s*([A-Za-z0-9_/\-]+)", r"(?i)endpoint[:：]\s*([A-Za-z0-9_/\-]+)"),
    "project": (r"(?i)任务[:：]\s*([^\n]+)", r"(?i)里程碑[:：]\s*([^\n]+)"),
    "academic": (r"(?i)关键词[:：]\s*([^\n]+)", r"(?i)关键字[:：]\s*([^\n]+)"),
}
# Words that begin a heading, by kind of document.
HEADINGS = {
    "academic": "abstract|introduction|related work|method(?:ology)?|experiment(?:s)?|result(?:s)?|discussion|conclusion|references|摘要|引言|相关工作|方法|实验|结果|讨论|结论|参考文献",
    "technical": "overview|architecture|api|endpoint|installation|configuration|usage|example|troubleshooting|概述|架构|接口|安装|配置|示例",
    "project": "goal|scope|timeline|milestone|task|risk|owner|status|目标|范围|里程碑|任务|风险|负责人|进度",
}
HEADING_STARTS = ("第一", "第二", "第三", "核心", "关键", "结论", "建议")
SENTENCE_ENDS = ("。", "？", "！", "：", "；", "...", "”", ")", "）")
# Words that show a document's form, with their weight in points; order decides ties.
FORMS = (
    ("paper", 1.5, ("abstract", "摘要", "keywords", "关键词", "doi:", "issn", "journal", "期刊", "vol.", "volume", "references", "参考文献", "bibliography")),
    ("thesis", 2, ("学位论文", "毕业论文", "硕士论文", "博士论文", "dissertation", "master thesis", "phd thesis", "致谢", "acknowledgements")),
    ("textbook", 1.5, ("习题", "练习题", "本章小结", "学习目标", "课后", "exercise")),
    ("book", 1.2, ("isbn", "出版社", "版权所有", "publisher", "copyright", "前言", "preface", "目录", "contents")),
    ("exam", 2, ("试卷", "考试", "满分", "答题", "考生", "exam paper", "time allowed", "total marks")),
    ("report", 2, ("调研报告", "研究报告", "分析报告", "工作报告", "executive summary", "findings", "recommendations", "结论与建议")),
    ("slides", 2, ()),
    ("project", 2, ("需求文档", "设计文档", "需求分析", "架构设计", "里程碑", "甘特图", "user story", "sprint", "backlog")),
    ("technical", 1.5, ("readme", "installation", "api reference", "endpoint", "configuration", "getting started", "安装", "配置说明")),
)
# What tells a header of an exam's section from a question.
OPTION_MARKS = ("?", "？", "A.", "B.", "C.", "D.", "A、", "B、", "C、", "D、")
QUESTION_CUES = ("请", "说明", "分析", "计算", "证明", "回答", "作答", "根据", "为什么", "如何", "是否")
HEADER_WORDS = ("选择题", "单项选择", "多项选择", "判断题", "填空题", "简答题", "论述题", "计算题", "证明题", "材料分析", "案例分析", "综合题", "阅读理解", "作文题")
HEADER_TOKENS = ("本题", "每题", "共", "分")


def group_of(pattern: str) -> int:
    """1 if the pattern captures something, else 0."""
    return min(1, re.compile(pattern).groups)


def is_chinese(pattern: str) -> bool:
    """Whether a pattern's words are all Chinese: it can't match a text without such characters."""
    bare = re.sub(r"\(\?[a-z]+\)|\\.", "", pattern)
    return bool(re.search("[一-鿿]", bare)) and not re.search("[A-Za-z]", bare)


def all_of(c: Column, pattern: str) -> Column:
    """All matches; texts without a Chinese character are spared the patterns that need one."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group_of(pattern)))
    return F.when(c.rlike("[一-鿿]"), found).otherwise(F.array().cast("array<string>")) if is_chinese(pattern) else found


def labelled(c: Column, patterns, flags: str = "") -> Column:
    """Structs (kind, label) of every match of every (kind, pattern); a text that several match is listed for each."""

    def one(kind: str, pattern: str) -> Column:
        return F.transform(all_of(c, flags + pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    return F.flatten(F.array(*[one(k, p) for k, p in patterns]))


def term_type(term: Column) -> Column:
    out = None
    for name, words in TERM_TYPES:
        found = X.has_any(F.lower(term), words)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.when(term.rlike("[A-Z][a-z]+"), "entity").otherwise("general")


def terms(c: Column) -> Column:
    """Marked strings of 2 to 30 characters, trimmed, as often as they occur."""
    found = F.flatten(F.array(*[F.transform(all_of(c, p), X.strip_all) for p in TERMS]))
    return F.filter(found, lambda x: F.length(x).between(2, 30))


def category(c: Column, name: str, limit: int = 8) -> Column:
    """The first `limit` statements of a category, by pattern, then place; those that begin alike count once."""
    squeeze = lambda x: F.substring(F.regexp_replace(X.strip_all(x), r"\s+", " "), 1, 280)
    found = F.filter(F.flatten(F.array(*[F.transform(all_of(c, p), squeeze) for p in CATEGORIES[name]])), lambda x: F.length(x) >= 10)
    return X.first_alike(found, 80, limit)


#: Runs of characters in which named terms lie.
RUNS = re.compile("[A-Z][A-Za-z0-9]{2,}|[一-龥]{2,}")


def named_terms(c: Column) -> Column:
    """Distinct words of a capital and two letters or digits more, or of 2 to 5 Chinese characters, in order."""
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^(?:[A-Z][A-Za-z0-9]{2,}|[一-龥]{2,5})$")))


def occurrences(text: str, terms: list[str]) -> list[tuple[str, int]]:
    """Each term (as named_terms gives them) with how often it occurs in the text, also within words; none overlaps itself.

    A term lies within a run of its own characters, so each different run is walked once, whatever the number of terms.
    """
    n = dict.fromkeys(terms, 0)
    latin, chinese = (sorted({len(w) for w in terms if (w[0] <= "Z") == x}) for x in (True, False))
    for run, times in Counter(RUNS.findall(text)).items():
        free = {}
        for at, first in enumerate(run):
            if "Z" < first < "一":
                continue
            for size in latin if first <= "Z" else chinese:
                if at + size > len(run):
                    break
                w = run[at : at + size]
                if w in n and free.get(w, 0) <= at:
                    n[w] += times
                    free[w] = at + size
    return list(n.items())


def term_frequencies(c: Column) -> Column:
    """Structs (concept, frequency) of a text's named terms."""

    @F.pandas_udf("array<struct<concept:string,frequency:bigint>>")
    def count(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or ws is None else occurrences(t, list(ws)) for t, ws in zip(texts, terms, strict=True)], dtype=object)

    return count(c, named_terms(c))


def concept_relevance(c: Column, concept: Column, dense: Column) -> tuple[Column, Column]:
    """How often a concept occurs in the text, and its relevance."""
    n = ((F.length(c) - F.length(F.replace(c, concept, F.lit("")))) / F.length(concept)).cast("bigint")
    return n, relevance(n, dense)


def relevance(n: Column, dense: Column) -> Column:
    return F.round(F.least(F.lit(1.0), n * 0.1 + F.coalesce(dense, F.lit(0.0)) * 0.5), 3)


def stems(pattern: str) -> list[str]:
    """Strings, in small letters, of which a text that matches (?:a|b|c) has one: the plain beginnings of its words."""
    found = set()
    for word in pattern.removeprefix("(?:").removesuffix(")").split("|"):
        plain, rest = re.fullmatch(r"((?:\\\.|[^\\\[?*+{.])*)(.*)", word).groups()
        found.add((plain[:-1] if rest[:1] in {"?", "*", "{"} else plain).replace("\\.", ".").lower())
    return sorted(s for s in found if not any(o != s and o in s for o in found))


def count_marks(c: Column, low: Column, chinese: Column, pattern: str) -> Column:
    """How often the words of (?:a|b|c) occur, letters in either case; low is c in small letters, chinese whether it has a Chinese character.

    Only texts that hold the beginning of a word are searched, and there a place whose character begins none is passed at once.
    """
    first = "".join(sorted({w[0] for w in pattern.removeprefix("(?:").split("|")}))
    n = F.regexp_count(c, F.lit(f"(?i)(?=[{first}])(?:{pattern})"))
    plain = [s for s in stems(pattern) if not re.search("[一-鿿]", s)]
    other = [s for s in stems(pattern) if s not in plain]
    return F.when(X.has_any(low, plain) | (chinese & X.has_any(low, other)), n).when(c.isNotNull(), 0)


def concept_chunk(c: Column, traditional: Column) -> Column:
    """A chunk's concept by weighted marks (ties go to the first one); the traditional class if there are none, or for filler.

    Each mark is counted once a text, whatever its score is used for.
    """

    def counted(x: Column) -> Column:
        marks = [count_marks(x["c"], x["low"], x["chinese"], p) for _, p in CONCEPT_MARKS]
        more = [count_marks(x["c"], x["low"], x["chinese"], DEFINED), F.regexp_count(x["c"], F.lit(EXERCISE))]
        return F.struct(x["traditional"].alias("traditional"), F.array(*marks, *more).alias("n"))

    def kind(x: Column) -> Column:
        n = {k: x["n"][i] for i, (k, _) in enumerate(CONCEPT_MARKS)}
        score = {k: 10 * v + F.when(v > 1, 5).otherwise(0) for k, v in n.items()}
        score["definition"] = score["definition"] + 15 * x["n"][len(n)]
        score["example"] = score["example"] + 12 * x["n"][len(n) + 1]

        def best_of(best: Column) -> Column:
            out = F.when((x["traditional"] == "filler") | (best < 10), x["traditional"])
            for k, v in score.items():
                out = out.when(v == best, k)
            return out

        return X.once(F.greatest(*score.values()), best_of)

    return X.once(X.once(F.struct(c.alias("c"), F.lower(c).alias("low"), c.rlike("[一-鿿]").alias("chinese"), traditional.alias("traditional")), counted), kind)


def concept_line(line: Column) -> Column:
    """The concept that a line's marks show; general without any."""
    out = None
    for k, p in CONCEPT_MARKS:
        found = line.rlike("(?i)" + p)
        out = F.when(found, k) if out is None else out.when(found, k)
    return out.when(line.rlike(EXERCISE), "example").otherwise("general")


def points(c: Column, kind: str) -> Column:
    """What the text names as its points, sorted; without any, the distinct ones of its first 300 words."""
    items = F.flatten(F.transform(F.flatten(F.array(*[all_of(c, p) for p in POINTS[kind]])), lambda x: F.split(x, r"[，,;；、]\s*")))
    named = F.filter(F.transform(items, X.strip_all), lambda x: F.length(x).between(2, 40))
    words = F.slice(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{4,}|[一-鿿]{2,8}"), F.lit(0)), 1, 300)
    plain = F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]+$"), F.lower(w)).otherwise(w))
    return F.array_sort(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(plain)))


def keyword_heading(line: Column, kind: str) -> Column:
    return X.strip_all(line).rlike(rf"(?i)^(?:{HEADINGS[kind]})(?:[^\p{{L}}\p{{N}}_]|$)")


def visual_heading(line: Column, following: Column) -> Column:
    """A short line that looks like a heading: bold, before a long line, or with the words of one."""
    s = X.strip_all(line)
    starts = lambda words: s.rlike("^(?:" + "|".join(words) + ")")
    ends = F.lit(False)
    for mark in SENTENCE_ENDS:
        ends = ends | s.endswith(mark)
    open_ = (F.length(s) > 0) & (F.length(s) <= 50) & ~ends
    bold = s.startswith("**") & s.endswith("**")
    other = ~s.rlike(r"^\d+$") & ~s.rlike(r"^\[\[PAGE:\d+\]\]") & (F.coalesce(F.length(X.strip_all(following)) > 100, F.lit(False)) | starts(HEADING_STARTS))
    return open_ & (bold | other)


def section_header(c: Column, marker: Column, level: Column) -> Column:
    """Whether an exam's block is the header of a section."""
    s = X.strip_all(F.regexp_replace(c, r"\s+", " "))
    fits = (level == 1) | marker.isin("zh_big", "chapter")
    short = F.length(s).between(1, 50)
    named = X.has_any(s, HEADER_WORDS) | X.has_any(s, HEADER_TOKENS)
    return fits & short & ~X.has_any(s, OPTION_MARKS) & ~X.has_any(s, QUESTION_CUES) & named


#: Scores are counted in twentieths of a point, so that sums of weights and half of them are whole numbers and ties are exact.
TWENTIETHS = 20


def twentieths(points: float) -> int:
    return round(points * TWENTIETHS)


def form_scores(c: Column, name: Column, pages: Column) -> dict[str, Column]:
    """Scores of a document's forms, in twentieths of a point."""
    head = F.lower(F.concat(name, F.lit(" "), F.substring(c, 1, 4000)))
    tail = F.when(F.length(c) > 2000, F.lower(F.substring(c, -2000, 2000))).otherwise(head)
    score = {k: twentieths(w) * X.hits(head, words) for k, w, words in FORMS}
    yes = lambda cond, n: F.when(cond, n).otherwise(0)
    score["paper"] = 30 * sum(((F.contains(head, F.lit(w)) | F.contains(tail, F.lit(w))).cast("int") for w in FORMS[0][2]), F.lit(0)) + yes(c.rlike(r"\[\d+\]|\([\p{L}\p{N}_]+,\s*\d{4}\)"), 40)
    score["paper"] = F.when(score["thesis"] > 0, (score["paper"] / 2).cast("int")).otherwise(score["paper"])
    score["textbook"] = score["textbook"] + yes(head.rlike("第.{1,3}章"), 30)
    score["book"] = score["book"] + yes(pages > 80, 20) + yes(pages > 200, 20)
    score["exam"] = score["exam"] + yes(c.rlike(r"(?m)(?:第\s*[一二三四五六七八九十\d]+\s*题|^\s*\d+[\.、。])"), 20)
    lines = F.filter(F.transform(F.split(c, "\n"), X.strip_all), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 30))
    score["slides"] = yes((short > 0.65 * F.size(lines)) & (F.size(lines) > 10), 40) + yes(head.rlike("slide|ppt"), 40)
    score["technical"] = score["technical"] + yes(c.rlike("```|`[^`]+`"), 20)
    return score


def form(c: Column, name: Column, pages: Column) -> Column:
    """The form with the highest score; of equals the first; general without any."""
    score = form_scores(c, name, pages)
    best = F.greatest(*score.values())
    out = F.when(best <= 0, "general")
    for k, v in score.items():
        out = out.when(v == best, k)
    return out


def comparable(c: Column) -> Column:
    """A title without case, space and punctuation, to compare by."""
    return F.regexp_replace(F.lower(X.strip_all(c)), r"[\s\-_.:/\\|()\[\]【】（）·*★#]+", "")
