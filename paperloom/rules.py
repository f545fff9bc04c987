"""Constants of the operators: word lists, patterns, weights and limits. Fixed values."""

# --- text

#: Java's trim() takes all characters up to U+0020; SQL's trim only spaces.
EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"

SECTION_HEADINGS = ("Abstract", "1 Introduction", "2 Proposed Method", "3 Experiments", "Conclusion", "References")
SECTION_TYPES = ("ABSTRACT", "INTRODUCTION", "METHOD", "EXPERIMENT", "CONCLUSION", "REFERENCES")

NUMBERING = r"^\s*(\d+(?:\.\d+)*|[ivxlcdm]+)[.)、:-]?\s+"
TITLE_NUMBERING = r"^\s*(\d+(?:\.\d+)*|[IVXLCDMivxlcdm]+)[.)、:-]?\s+"
NUMBERED_HEADING = r"^[0-9IVXLCDMivxlcdm]+[.)、]?\s+[A-Z][A-Za-z0-9 ,&/-]{2,80}$"
TITLE_CASE_HEADING = r"^[A-Z][A-Za-z0-9 ,&/-]{2,60}$"
HEADING_CHARS = 120
HEADING_WORDS = 5

#: Section types by title, in the order in which they are tried: whole titles, then parts of titles.
TITLE_RULES = (
    ("ABSTRACT", "is", ("abstract", "摘要")),
    ("INTRODUCTION", "is", ("introduction", "引言", "绪论")),
    ("RELATED_WORK", "has", ("related work", "literature review", "background")),
    ("METHOD", "has", ("method", "methodology", "approach", "framework", "architecture", "model design", "system design", "proposed")),
    ("EXPERIMENT", "has", ("experiment", "evaluation", "empirical study", "case study", "ablation", "implementation details")),
    ("RESULT", "match", (r"\bresults?\b|analysis|performance",)),
    ("DISCUSSION", "has", ("discussion", "limitation")),
    ("CONCLUSION", "has", ("conclusion", "future work")),
    ("REFERENCES", "is", ("references", "bibliography", "参考文献", "参考资料", "参考书目")),
    ("APPENDIX", "has", ("appendix", "supplementary")),
    (
        "BACK_MATTER",
        "has",
        (
            "acknowledg",
            "author contribution",
            "contribution statement",
            "conflict of interest",
            "competing interest",
            "data availability",
            "funding",
            "ethics statement",
        ),
    ),
)

#: Section types by content, where the title tells none.
CONTENT_RULES = (
    ("METHOD", ("we propose", "proposed method", "algorithm", "architecture", "module", "training procedure", "model consists")),
    ("EXPERIMENT", ("dataset", "baseline", "evaluation", "experiment", "ablation", "metric")),
    ("RESULT", ("outperform", "performance", "results show", "comparison", "improvement")),
    ("DISCUSSION", ("limitation", "future work", "discussion", "threats to validity")),
    ("BACK_MATTER", ("author contributions", "conflict of interest", "data availability", "funding", "acknowledgement", "acknowledgment")),
)

#: Lines that publishers add, by rule: a pattern over the trimmed lower-case line.
NOISE_RULES = (
    ("journal_homepage", r"journal homepage"),
    ("available_online", r"available online\s+\d{1,2}\s+[a-z]+\s+\d{4}"),
    ("doi", r"doi\.org|^doi:"),
    ("copyright", r"©|copyright|published by"),
    ("received", r"\b(received|revised|accepted)\b.*\d{4}"),
    ("corresponding_author", r"corresponding author"),
    ("email_label", r"e-mail address|email address"),
    ("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    ("permission", r"provided proper attribution.*permission to reproduce|permission to reproduce.*provided proper attribution"),
    ("equal_contribution", r"equal contribution|work performed while at"),
    ("conference", r"conference on neural information processing systems|\bnips\s+\d{4}"),
    ("arxiv", r"a *r *x *i *v *:"),  # "arxiv:" with blanks anywhere
    ("affiliation", r"^[a-z]\s+(school|department|college|faculty|institute|laboratory|university)\b"),
)

#: Strings one of which a line must hold to meet a noise rule; they are quicker to find than the pattern.
NOISE_NEEDS = {
    "journal_homepage": ("journal homepage",),
    "available_online": ("available online",),
    "doi": ("doi",),
    "copyright": ("©", "copyright", "published by"),
    "received": ("received", "revised", "accepted"),
    "corresponding_author": ("corresponding author",),
    "email_label": ("e-mail address", "email address"),
    "email": ("@",),
    "permission": ("permission to reproduce",),
    "equal_contribution": ("equal contribution", "work performed while at"),
    "conference": ("conference on neural information processing systems", "nips"),
    "arxiv": (":",),
}

#: The line ends before lines that name an algorithm.
ALGORITHM_LINE = r"(?<=\n)(?=(?i:[ \t]*(?:algorithm|pseudocode|encode-process-decode)))"

TARGET_CHARS, MAX_CHARS, OVERLAP_CHARS, NOISE_CHARS = 1600, 2200, 200, 30

# --- lexical index

TOKEN_SPLIT = r"[\s.,;:!?()\[\]{}<>\"'=+\-*/|\\@#$%^&~`]+"
K1, B = 1.5, 0.75
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any",
    "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "this", "that", "these", "those", "it", "its", "we", "they", "them",
    "their", "our", "he", "she", "his", "her", "which", "who", "whom", "what", "when", "where", "how", "if", "then", "than", "also", "about", "just",
    "very", "too", "well", "here", "there", "zero", "one", "two", "three", "first", "second", "using", "used", "based", "proposed", "results", "show",
    "shown", "table", "figure", "fig", "et", "al", "via", "per", "due", "thus",
)

# --- ranking

RRF_K = 60
TYPE_WEIGHTS = (("paper_profile", 0.40), ("section_summary", 0.35), ("raw_chunk", 0.25))
SECOND_HIT_WEIGHT, CROSS_TYPE_BONUS, COVERAGE_WEIGHT, REVIEW_PENALTY = 0.25, 0.05, 0.20, 0.30
REVIEW_WORDS = ("review", "survey", "综述")
UNKNOWN_TITLE = "未知论文"

#: Candidate policies by phrase: (phrases, minimum, maximum, share of the top score), in order.
UNIQUE_PHRASES = ("唯一", "only one", "unique")
POLICIES = (
    ("unique", UNIQUE_PHRASES, 1, 1, 0.78),
    ("which", ("哪一篇", "哪篇", "找出", "which paper"), 1, 3, 0.75),
    ("list", ("哪些", "列出", "which papers"), 1, 6, 0.52),
)
TWO_WHICH = ("哪篇", 2, 3, 0.68)
DEFAULT_POLICY = (1, 4, 0.65)
MAX_SELECTED = 6

BACKGROUND_MARKS = (
    "existing method",
    "existing graph",
    "current method",
    "current graph",
    "related work",
    "state of the art",
    "previous studies",
    "本节综述",
    "现有方法",
    "现有图神经网络",
    "已有方法",
)
DIRECT_MARKS = ("we propose", "proposed model", "本文提出", "本研究提出", "构建图结构", "生成邻接矩阵", "builds a graph", "constructs a graph", "adjacency matrix")

# --- knowledge and facts

TIERS = (("GOLD", 3), ("SILVER", 2))
METHOD_PRIORITY = (("USER", 5), ("LLM", 4), ("PROFILE", 3), ("DETERMINISTIC", 2), ("SECTION_SUMMARY", 1))
FAMILIES = (
    ("RESEARCH", ("RESEARCH_DOMAIN", "RESEARCH_TASK", "RESEARCH_PROBLEM", "KEYWORD")),
    ("METHOD", ("METHOD", "MODEL_COMPONENT")),
    ("DATASET", ("DATASET", "INPUT_VARIABLE")),
    ("RESULT", ("RESULT", "COMPARISON")),
    ("LIMITATION", ("LIMITATION", "FUTURE_WORK")),
)
TOPIC_TYPES = ("RESEARCH_DOMAIN", "RESEARCH_TASK", "METHOD", "DATASET", "METRIC")
CONFLICT_TYPES = ("EXPERIMENT_SETTING", "METRIC", "RESULT", "COMPARISON")
TOPIC_LABEL_CHARS = 100
TAG_SPLIT = r"[,，;；|/\n]"
LOOSE = r"[\s，,。；;：:（）()\[\]{}]"

NUMBER = r"([0-9]+(?:\.[0-9]+)?(?:e[-+]?\d+)?)"
PARAMETERS = (
    ("learning_rate", r"(?i)learning\s+rate\s*(?:of|=|:|was|is)?\s*" + NUMBER),
    ("batch_size", r"(?i)batch\s+size\s*(?:of|=|:|was|is)?\s*(\d+)"),
    ("epochs", r"(?i)(?:number\s+of\s+)?epochs?\s*(?:of|=|:|was|is)?\s*(\d+)"),
    ("dropout", r"(?i)dropout(?:\s+rate)?\s*(?:of|=|:|was|is)?\s*([0-9]+(?:\.[0-9]+)?)"),
    ("window_size", r"(?i)(?:window|sequence)\s+(?:size|length)\s*(?:of|=|:|was|is)?\s*(\d+)"),
)
PARAMETER_UNITS = (("batch_size", "samples"), ("epochs", "epochs"), ("window_size", "steps"))
EXCERPT_BEFORE, EXCERPT_AFTER = 100, 160
#: What a reader of a spec is told, by what it lacks.
SAFE_DEFAULTS = (
    ("always", "Claim a metric of the paper only where evidence states it."),
    ("dataset", "Without the dataset, small made-up input serves for smoke checks only."),
    ("hyperparameters", "Missing hyper-parameters stay open settings; a default is not a fact of the paper."),
    ("conflicts", "Conflicting facts are handed on with all their values; none is chosen."),
)
FACT_CONFIDENCE, TRUSTED_CONFIDENCE = 0.82, 0.70
CRITICAL_GROUPS = (
    ("architecture", ("ARCHITECTURE", "ARCHITECTURE_COMPONENT", "ARCHITECTURE_CONNECTION")),
    ("algorithm", ("ALGORITHM_STEP", "IMPLEMENTATION")),
    ("hyperparameters", ("HYPERPARAMETER", "HYPERPARAMETER_TABLE")),
    ("dataset", ("DATASET",)),
    ("preprocessing", ("PREPROCESSING",)),
    ("loss", ("LOSS",)),
    ("metrics", ("METRIC",)),
    ("environment", ("ENVIRONMENT",)),
)

# --- questions and answers

LATIN_TERM = r"[A-Za-z][A-Za-z0-9+\-]{1,}"
GENERIC_TERMS = (
    "paper", "papers", "method", "methods", "model", "models", "forecast", "forecasting", "prediction", "wind", "speed", "power",
    "time", "series", "论文", "方法", "模型", "预测",
)
MAX_TERMS = 12
EXPLICIT_PAPER = r"(?i)(论文|paper)\s*[#：:]?\s*\d+|《[^》]{2,}》"
NEEDS_CONTEXT = r"它|这个|这个方法|该方法|该论文|上述|前者|后者|二者|两者|相比|还有|继续|进一步|那么|这些|其|呢"
RESEARCH_GATE = (
    r"改进|优化|建议|方向|探索|未来|提升|扩展|不足|局限|尝试|替代|对比|比较|创新|新方法|新思路|"
    r"improve|optimize|suggest|explore|future|limitation|extension|alternative|compare|novel|innovative"
)
MISSING_SOURCE = "[待补充来源]"
SAVE_TYPES = ("draft", "idea", "todo", "implemented")

#: Assets worth a closer look, by type: words of the caption, or of caption and text below this confidence.
VISION_FIGURE = r"architecture|framework|flowchart|network|structure|pipeline|workflow"
VISION_TABLE = r"parameter|configuration|setting|algorithm|hyperparameter"
VISION_EQUATION = r"loss|objective|input|output|where|defined|learning|optimization"
VISION_CONFIDENCE = 0.7

#: Points of fact types and of section words, most first.
FACT_POINTS = ((5, r"HYPERPARAMETER|^LOSS$|^DATASET$"), (4, r"ALGORITHM|^IMPLEMENTATION$"), (3, r"ARCHITECTURE"), (2, r"^EQUATION$|^PREPROCESSING$"))
SECTION_POINTS = ((4, r"METHOD|MODEL|ALGORITHM"), (3, r"EXPERIMENT|RESULT|IMPLEMENT"), (2, r"ABSTRACT|INTRODUCTION"), (0, r"REFERENCE|CONFLICT|AUTHOR"))

# --- routes of questions

#: Labels of knowledge and of sections that a route may name.
KNOWLEDGE_LABELS = (
    "RESEARCH_DOMAIN", "RESEARCH_TASK", "RESEARCH_PROBLEM", "BACKGROUND", "METHOD", "MODEL_COMPONENT", "DATASET", "INPUT_VARIABLE",
    "EXPERIMENT_SETTING", "METRIC", "RESULT", "COMPARISON", "CONTRIBUTION", "LIMITATION", "CONCLUSION", "FUTURE_WORK", "KEYWORD",
)
SECTION_LABELS = ("ABSTRACT", "INTRODUCTION", "RELATED_WORK", "METHOD", "EXPERIMENT", "RESULT", "DISCUSSION", "CONCLUSION", "APPENDIX")

#: Intents by words: (intent, words, knowledge labels, sections). Those of the first list add up, the last one names the intent.
ROUTES = (
    ("DATASET", ("数据集", "数据来源", "样本", "scada", "dataset", "data set"), ("DATASET", "INPUT_VARIABLE"), ("DATA", "DATASET", "EXPERIMENTS", "EXPERIMENT")),
    ("EXPERIMENT_SETTING", ("学习率", "批大小", "batch size", "超参数", "参数设置", "实验设置", "训练设置", "implementation detail"), ("EXPERIMENT_SETTING",), ("EXPERIMENTS", "EXPERIMENT", "METHODS", "METHOD")),
    ("METRIC", ("评价指标", "评估指标", "指标", "metric", "mae", "rmse", "accuracy", "precision", "recall"), ("METRIC",), ("EXPERIMENTS", "EXPERIMENT", "RESULTS", "RESULT")),
    ("RESULT", ("实验结果", "结果如何", "提升多少", "性能", "效果", "result", "performance", "对比结果"), ("RESULT", "COMPARISON"), ("RESULTS", "RESULT", "EXPERIMENTS", "EXPERIMENT")),
    ("METHOD", ("什么方法", "使用的方法", "采用什么", "模型结构", "算法", "方法", "模型", "method", "model", "architecture"), ("METHOD", "MODEL_COMPONENT"), ("METHODS", "METHOD", "METHODOLOGY", "MODEL")),
)
#: Intents that stand alone, in the order in which they win over all others.
SOLE_ROUTES = (
    ("RESEARCH_TASK", ("研究问题", "解决什么问题", "研究任务", "研究目标", "task", "problem"), ("RESEARCH_TASK", "RESEARCH_PROBLEM"), ("ABSTRACT", "INTRODUCTION")),
    ("LIMITATION", ("局限", "不足", "缺点", "限制", "limitation", "weakness"), ("LIMITATION",), ("LIMITATIONS", "DISCUSSION", "CONCLUSION")),
    ("CONTRIBUTION", ("贡献", "创新点", "创新之处", "contribution", "novelty"), ("CONTRIBUTION",), ("ABSTRACT", "INTRODUCTION", "CONCLUSION")),
)
BROAD_WORDS = ("哪些论文", "相关论文", "研究方向", "发展趋势", "当前研究", "近年来", "综述", "survey", "trend", "related work")
FUZZY_WORDS = ("新颖", "值得", "比较好", "相关的", "类似", "可能", "启发", "方向")
WHOLE_WORDS = ("全面", "综合", "从整体", "详细介绍", "完整说明", "优缺点", "如何实现")
MODEL_MARKERS = (
    "为什么", "原因", "区别", "不同", "比较", "相比", "优缺点", "优势", "劣势", "影响", "关系", "如何结合", "是否适合", "为什么有效",
    "why", "difference", "compare", "trade-off", "tradeoff", "relationship",
)
MODEL_LEAST, MODEL_HIGH = 0.60, 0.80
CHOICES = ("NEEDED", "NOT_NEEDED", "UNCERTAIN")

#: Words of a question that tell nothing, and phrases that are cut from it.
STOP_TERMS = ("论文", "哪些", "什么", "如何", "使用", "进行", "相关", "研究", "方法", "模型", "结果", "数据", "实验", "分析", "比较", "介绍", "一个", "这个", "这些", "当前", "主要")
STOP_PHRASES = ("请问", "帮我", "一下", "哪几篇", "有没有")
QUESTION_TERM = r"[A-Za-z][A-Za-z0-9+_.-]{1,}"
CATALOG_LOOSE = r"""[\s，,。；;：:（）()\[\]{}"']"""
KNOWN_TERMS = ("VMD", "CEEMD", "CEEMDAN", "小波", "ARMA", "ARIMA", "VAR", "ESN", "克里金", "Transformer", "图神经网络", "图消息传递", "光伏", "LSTM")
GRAPH_WORD, GRAPH_TERMS = "图", ("图结构", "节点", "近邻")
TERM_SPLIT = r"[,，;；\n\s]+"

#: Families of knowledge labels when gaps are looked for, with the sections that may fill them.
GAP_FAMILIES = (
    ("RESEARCH", ("RESEARCH_DOMAIN", "RESEARCH_TASK", "RESEARCH_PROBLEM", "KEYWORD"), ("ABSTRACT", "INTRODUCTION")),
    ("METHOD", ("METHOD", "MODEL_COMPONENT"), ("METHOD",)),
    ("DATASET", ("DATASET", "INPUT_VARIABLE"), ("EXPERIMENT", "METHOD")),
    ("EXPERIMENT", ("EXPERIMENT_SETTING",), ("EXPERIMENT", "METHOD")),
    ("METRIC", ("METRIC",), ("EXPERIMENT", "RESULT")),
    ("RESULT", ("RESULT", "COMPARISON"), ("EXPERIMENT", "RESULT")),
    ("CONTRIBUTION", ("CONTRIBUTION",), ("ABSTRACT", "INTRODUCTION", "CONCLUSION")),
    ("LIMITATION", ("LIMITATION", "FUTURE_WORK"), ("DISCUSSION", "CONCLUSION")),
    ("BACKGROUND", ("BACKGROUND", "CONCLUSION"), ("ABSTRACT", "INTRODUCTION", "RELATED_WORK")),
)
#: Sections to read first, by words of the question; the last entry holds for all others.
SECTION_ORDERS = (
    (("方法", "method", "模型", "框架"), ("METHOD", "RELATED_WORK", "INTRODUCTION")),
    (("实验", "结果", "experiment", "result", "性能"), ("EXPERIMENT", "RESULT", "DISCUSSION")),
    (("局限", "不足", "缺点", "limitation", "weakness"), ("DISCUSSION", "CONCLUSION", "RESULT", "EXPERIMENT")),
    (("创新", "贡献", "contribution", "novel"), ("ABSTRACT", "INTRODUCTION", "METHOD", "CONCLUSION")),
    (("对比", "比较", "区别", "compare", "difference"), ("METHOD", "EXPERIMENT", "RESULT", "DISCUSSION", "CONCLUSION")),
    ((), ("ABSTRACT", "INTRODUCTION", "METHOD", "EXPERIMENT", "RESULT", "CONCLUSION")),
)

# --- model output, ideas and drafts

MISSING_FIELD = "信息不足"
UNUSABLE = r"信息不足|无法总结|无法提供"
FIELD_MARK = r"(?m)^\s*(?:#{1,6}\s*)?(?:[-*]\s*)?(?:\d+[.、]\s*)?(?:\*\*)?"
FIELD_END = r"(?:\*\*)?\s*[:：]?\s*"
PROFILE_FIELDS = ("研究问题", "方法概述", "实验与评估", "主要贡献", "局限性", "关键词", "完整画像")
IMPROVEMENT_INTENT = (
    r"怎么改进|如何改进|怎样改进|如何优化|怎么优化|怎样优化|有什么建议|有哪些建议|给些建议|给点建议|有什么推荐|改进建议|优化建议|研究建议|"
    r"改进方向|优化方向|研究方向|未来方向|未来研究|进一步研究|后续研究|下一步|还有什么可以|还可以做什么|还能做什么|值得探索|值得研究|值得深入|"
    r"可以尝试|可以怎么提升|哪些方面可以改进|有没有更好的|怎么提升|如何提升|怎样提升|有什么不足|有哪些局限|局限性是什么|limitation|future work|"
    r"future research|improvement|可以怎么扩展|如何扩展|怎么扩展"
)
WRITING_SECTIONS = ("ABSTRACT", "INTRODUCTION", "RELATED_WORK", "BACKGROUND", "DISCUSSION", "CONCLUSION", "METHOD")
WRITING_CHARS = 36_000
DEFAULT_OUTLINE = ("1.1 研究背景与问题提出", "1.2 相关技术与方法演进", "1.3 国内外研究现状", "1.4 现有研究不足", "1.5 本章小结")
DONE_STATES, FAILED_STATES = ("COMPLETED", "PARSED", "VECTORIZED", "SUCCESS"), ("FAILED", "ERROR")
