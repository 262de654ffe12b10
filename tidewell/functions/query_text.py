"""What a question's text asks for: sources, file types, newest things, lists, a period, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases and word lists of the questions' language.
RECENCY_PHRASES = [
    "최근", "최신", "가장 최근", "요즘", "이번 주", "이번달", "이번 분기", "최근에 등록", "최근 등록", "최근 생성", "최근에 생성",
    "새로 등록", "방금 등록", "새로 생성", "최근 추가", "새로 추가", "새로운", "최근 올라온", "최근 만든",
]
LISTING_PHRASES = ["목록", "리스트", "현황", "전체", "모두", "몇 개", "몇개", "진행중", "진행 중", "완료된", "대기중", "대기 중", "최근", "이번 주", "이번달", "이번 분기"]
SOURCE_WORDS = {
    "jira": ["지라", "jira", "이슈에서", "이슈로"],
    "confluence": ["컨플루언스", "컨플에서", "컨플루", "confluence"],
    "teams": ["팀즈에서", "팀즈 대화", "팀즈에", "teams", "대화에서", "채팅에서", "채널에서"],
    "sharepoint": ["쉐어포인트", "sharepoint"],
    "docs": ["플랫폼매뉴얼", "플랫폼 매뉴얼", "매뉴얼에서", "개발문서", "개발 문서"],
}
EXTENSION_WORDS = {
    ".xlsx,.xls": ["엑셀", "excel", ".xlsx", ".xls"],
    ".pptx,.ppt": ["ppt", "파워포인트", "기획서", "발표자료", "프레젠테이션"],
    ".docx,.doc": [".docx", ".doc", "word 문서"],
    ".pdf": [".pdf", " pdf "],
}
#: The source that files are in.
FILE_SOURCE = "sharepoint"
#: Number before a unit, or a spelt-out number, and what a unit has in days; in order of priority.
PERIODS = [(r"(\d+)\s*(?:개월|달)", 30), (r"(\d+)\s*주\s*(?:일|간|동안|이내)?", 7), (r"(\d+)\s*일\s*(?:간|이내|동안)?", 1)]
SPELT = [(r"한\s*달", 30), (r"두\s*달", 60), (r"세\s*달", 90)]
STOP_WORDS = [
    "찾아줘", "알려줘", "보여줘", "찾아봐", "알아봐", "정리해줘", "확인해줘", "알려주세요", "찾아주세요", "보여주세요",
    "있어", "없어", "어떻게", "어디서", "어디에", "언제", "뭐야", "뭔가", "무엇", "어떤", "어디",
    "관련해서", "관련된", "관련", "대해서", "대한", "이슈", "것", "거",
    "내용", "관련내용", "정보", "자료", "문서", "진행", "진행된", "진행했던", "진행중인", "관련자료", "내역", "현황", "결과",
    "하게된거야", "하게된", "된거야", "왜",
]
SUFFIXES = [
    "에서부터", "에서는", "에서도", "에서의", "에서만", "이었던", "이라는", "이라고", "이지만", "이므로", "이면서", "으로서", "으로의", "대로의",
    "에게서", "에서", "부터", "까지", "라는", "라고", "지만", "므로", "면서", "로서", "로의", "았던", "었던", "이야", "이에요", "이에서",
    "를", "을", "은", "는", "이", "가", "의", "에", "도", "와", "과", "건",
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def is_recency(query: Column | str) -> Column:
    return _any(F.lower(_c(query)), RECENCY_PHRASES)


def is_listing(query: Column | str) -> Column:
    return _any(F.lower(_c(query)), LISTING_PHRASES)


def explicit_days(query: Column | str) -> Column:
    """Days of the period that a query names, null if it names none."""
    q = _c(query)
    counted = [F.nullif(F.regexp_extract(q, p, 1), F.lit("")).cast("int") * days for p, days in PERIODS]
    return F.coalesce(*counted, *[F.when(q.rlike(p), days) for p, days in SPELT])


def source_filter(df: DataFrame, sources: list[str] | str) -> DataFrame:
    return df.filter(F.col("source").isin([sources] if isinstance(sources, str) else sources))


def url_extension_filter(df: DataFrame, exts: list[str], url: str = "url") -> DataFrame:
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), r"(?s)\?.*$", "")
    return df.filter(F.exists(F.array(*map(F.lit, exts)), lambda e: F.endswith(plain, e)))


def detect_filters(queries: DataFrame, source_words: dict[str, list[str]] | None = None, extension_words: dict[str, list[str]] | None = None, file_source: str = FILE_SOURCE) -> DataFrame:
    """Adds sources and exts that a query (q) names; a file type asks for the file source too."""
    q = F.lower("q")
    pick = lambda words, value: F.flatten(F.array(*[F.when(_any(q, w), value(k)).otherwise(F.array().cast("array<string>")) for k, w in words.items()]))
    sources = pick(source_words or SOURCE_WORDS, lambda k: F.array(F.lit(k)))
    exts = pick(extension_words or EXTENSION_WORDS, lambda k: F.array(*map(F.lit, k.split(","))))
    out = queries.withColumn("exts", exts).withColumn("sources", sources)
    return out.withColumn("sources", F.when((F.size("exts") > 0) & ~F.array_contains("sources", file_source), F.array_append("sources", F.lit(file_source))).otherwise(F.col("sources")))


def _stem(word: Column) -> Column:
    """The word without its longest ending of the list, if two characters are left."""
    longest = sorted(SUFFIXES, key=len, reverse=True)
    ending = F.get(F.filter(F.array(*map(F.lit, longest)), lambda s: F.endswith(word, s)), F.lit(0))
    stem = F.substr(word, F.lit(1), F.length(word) - F.length(ending))
    return F.when(ending.isNotNull() & (F.length(stem) >= 2), stem).otherwise(word)


def extract_keywords(query: Column | str, max_n: int = 3) -> Column:
    """Issue keys first, then words by falling length (in order of the text for equals), without endings and stop words."""
    q = F.coalesce(_c(query), F.lit(""))
    keys = F.regexp_extract_all(q, F.lit(r"([A-Z]+-\d+)"), 1)
    parts = F.flatten(F.transform(keys, lambda k: F.split(k, "-")))
    words = F.regexp_extract_all(q, F.lit("([가-힣A-Za-z0-9]+)"), 1)
    stems = F.transform(F.filter(words, lambda w: w.rlike("^[가-힣a-zA-Z]")), _stem)
    good = F.filter(stems, lambda s: (F.length(s) >= 2) & ~s.isin(STOP_WORDS) & s.rlike("[가-힣a-zA-Z]") & ~F.array_contains(parts, s))
    placed = F.array_sort(F.transform(good, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("w"))))
    return F.slice(F.concat(keys, F.transform(placed, lambda x: x["w"])), 1, max_n)


def merge_keywords(a: Column | str, b: Column | str, n: int = 5) -> Column:
    return F.slice(F.array_distinct(F.concat(_c(a), _c(b))), 1, n)


def effective_k(query: Column | str, k: int) -> Column:
    return F.when(is_listing(query), 3 * k).otherwise(k)
