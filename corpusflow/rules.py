"""Word lists, weights, patterns and limits the results depend on.

All rules that have to give the same result in any regex engine use explicit
character classes instead of ``\\w`` and ``\\b``.
"""

# ---- lexical index -------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
BM25_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "and", "or", "but", "to", "of", "in", "on", "at", "for", "by", "with",
    "from", "as", "that", "this", "these", "those", "it", "its",
)
BM25_PHRASES = ("cpu usage", "memory usage", "disk usage")
FIELD_WEIGHTS = {"text": 2.0, "h1": 3.0, "h2": 2.0, "h3": 1.0}

# ---- chunking ------------------------------------------------------------
CHUNK_LEVELS = ((2000, 240), (1000, 120), (500, 60))
CHUNK_SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", " ", "")
TEXT_EXTENSIONS = (".txt", ".text", ".md", ".pdf", ".doc", ".docx", ".xls", ".xlsx")
IMAGE_PLACEHOLDER = r"<<IMAGE:[0-9a-f]{8}>>"
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "svg")

# ---- ranking -------------------------------------------------------------
SOURCE_BOOSTS = {
    "papers/": 1.5,
    "papers/arxiv/": 1.4,
    "papers/semanticscholar/": 1.4,
    "research/": 1.3,
    "concepts/": 1.2,
    "authors/": 1.1,
    "institutions/": 1.1,
    "presentations/": 1.0,
    "notes/": 0.8,
    "chat/": 0.5,
}
HARD_EXCLUDES = ("tmp/", "debug/", "archive/", "test/")
KEYWORD_BOOSTS = {"attention": 1.2, "transformer": 1.2, "RAG": 1.3}
INTENT_PATTERNS = (
    ("entity", r"谁|哪个作者|作者是谁|谁写的|作者列表|第一作者|通讯作者|who\s+wrote|who\s+is|author\s+of|first\s+author|published|发表于|发表(在|于)"),
    ("temporal", r"最近|最新|latest|recent|近[几数]年|去年|今年|trend|进展|前沿|recently\s+published|new\s+papers"),
    ("literature", r"有哪些|哪些论文|找.*论文|找.*文献|论文.*有|文献.*有|papers?\s+(about|on|related|regarding)|literature\s+(about|on|of)|(about|on)\s+.*papers?|survey|综述|回顾|总结.*(文献|论文)"),
)
INTENT_PARAMS = {"entity": (5, False), "temporal": (12, True), "literature": (15, False), "general": (8, False)}
COMPLEX_HINT = r"比较|分析|总结|综述|为什么|如何|怎么|区别|评价|影响|方法|compare|analyze|summar|survey|why|how|difference|review|trade[- ]?off"

# ---- entity graph --------------------------------------------------------
KEYWORD_STOP_WORDS = (
    "method", "result", "paper", "study", "approach", "analysis", "data",
    "model", "system", "problem", "research", "using", "based", "proposed",
    "can", "use", "used", "also", "one", "two", "three", "may", "et", "al",
    "new", "different", "show", "find", "found", "results", "performance",
    "实验", "结果", "方法", "研究", "本文", "我们", "提出", "基于", "分析",
    "可以", "使用", "不同", "问题", "模型", "系统", "数据", "一种", "通过",
    "进行", "表明", "发现", "论文", "工作", "主要", "包括", "相关",
)
AFFILIATION_WORDS = (
    "University", "Institute", "College", "School", "Lab", "Laboratory", "Research",
    "Academy", "公司", "大学", "学院", "研究所", "实验室",
)
CITE_BRACKET = r"\[(\d+(?:[,，]\s*\d+)*)\]"
CITE_PAREN = r"\(([A-Z][a-z]+(?:\s+(?:&|and)\s+[A-Z][a-z]+)?),\s*(\d{4}[a-z]?)\)"
CITE_INLINE = r"([A-Z][a-z]+)\s+et\s+al\.?\s*\((\d{4}[a-z]?)\)"

# ---- topics, clarification, research reports -------------------------------
ACADEMIC_TERMS = ("paper", "papers", "research", "survey", "rag", "method", "model")
BROAD_MARKERS = ("相关", "内容", "看看", "研究", "介绍", "分析", "agent", "agents", "multi-agent")
BRANCH_TEMPLATES = (
    ("foundations and key concepts", "梳理核心概念、问题定义和技术脉络"),
    ("latest methods and representative works", "检索近年代表性论文、方法和实验结论"),
    ("applications, limitations and future directions", "总结应用价值、主要限制和后续研究机会"),
)
SECTION_SIGNALS = {
    "abstract": ("abstract", "摘要"),
    "introduction": ("introduction", "background", "引言", "背景"),
    "method": ("method", "approach", "algorithm", "方法", "模型"),
    "experiment": ("experiment", "evaluation", "result", "实验", "评估", "结果"),
    "conclusion": ("conclusion", "discussion", "结论", "讨论"),
    "references": ("references", "bibliography", "参考文献"),
}
ABLATION_WORDS = ("ablation", "baseline", "comparison", "消融", "基线", "对比")
SLIDE_PLACEHOLDERS = ("bridge", "draft", "debug", "todo", "tbd", "placeholder")
MANUSCRIPT_PLACEHOLDERS = ("plan", "research process", "内容待补充", "待补充", "研究过程", "研究阶段", "研究计划")
CLOSING_WORDS = ("总结", "结论", "展望", "closing")
OVERVIEW_WORDS = ("概览", "总览", "overview")

# ---- context assembly --------------------------------------------------------
MAX_TOKENS, RESERVE_RATIO, MIN_RELEVANCE = 3000, 0.2, 0.1
MAX_HISTORY_MESSAGES, MAX_HISTORY_TURNS, MAX_EVIDENCE, MAX_CHARS = 12, 6, 6, 12000
MODE_HINTS = {
    "quick": "优先给出简短、直接、可靠的回答，不要展开过多推导。",
    "router": "优先判断任务应该交给 quick 还是 deep。",
    "deep": "优先基于证据做结构化、分步骤的回答。",
}
MODE_DEMANDS = {
    "deep": "请优先基于证据回答；如信息不足，明确说明缺口；需要时给出分步骤分析。",
    "quick": "请直接给出简洁、可靠的回答，避免展开不必要的推导。",
    "router": "请根据当前问题判断路由倾向，只保留与路由相关的最小必要上下文。",
}
RELEVANCE = {"user_question": 1.0, "mode_hint": 0.95, "conversation_history": 0.6, "candidate_summary": 0.35}

# ---- conversation compression ------------------------------------------------
CONTEXT_WINDOW, TRIGGER_RATIO = 32000, 0.5
HEAD_MESSAGES, TAIL_TOKENS = 3, 20000
TOOL_ARG_MAX = 120
THRASH_MIN_SAVINGS, THRASH_LIMIT = 0.1, 2

# ---- memory and notes --------------------------------------------------------
LOW_VALUE = (
    "thanks", "thank you", "ok", "okay", "hello", "hi",
    "收到", "谢谢", "好的", "知道了", "明白了", "随便", "无所谓",
    "再见", "拜拜", "晚安", "早安",
)
LOW_VALUE_NOTES = (
    "thanks", "thank you", "ok", "okay", "hello", "hi",
    "收到", "谢谢", "好的", "知道了", "明白了", "随便", "无所谓",
)
DERIVABLE = (
    "file path", "file structure", "code pattern",
    "git commit", "git log", "pull request",
    "the function", "the class", "the module",
)
MEMORY_TYPES = (
    ("feedback", ("don't", "stop doing", "never do", "please don't", "shouldn't", "instead of", "not that",
                  "不要", "别", "不应该", "不是这样", "改一下", "不是这个意思", "太长了", "简洁", "不对", "说错了", "理解错了", "你误会了")),
    ("user", ("I prefer", "I like", "I usually", "my workflow", "I'm a", "我偏好", "我习惯", "我是", "我的研究方向", "我关注")),
    ("project", ("deadline", "milestone", "target", "plan to", "scheduled", "next week", "by Friday",
                 "截止", "目标", "计划", "下个月", "下周", "提交")),
    ("reference", ("check the", "look at", "see the", "the file at", "external", "link", "url", "slack", "drive",
                   "看一下", "参考", "链接", "文件在")),
)
MEMORY_ADVICE = {
    "feedback": "**How to apply:** Check this before similar tasks.",
    "project": "**How to apply:** Consider this when planning related work.",
    "user": "**How to apply:** Tailor responses accordingly.",
    "reference": "**How to apply:** Consult when the referenced resource is needed.",
}
INDEX_MAX_ENTRIES, INDEX_MAX_BYTES = 200, 25000
HIGH_VALUE_KINDS = ("decision", "constraint", "summary", "preference", "blocker", "memory")
HIGH_VALUE_HINTS = (
    "important", "must", "should", "remember", "constraint",
    "decision", "prefer", "always", "never", "key",
    "important for later",
    "重要", "必须", "约束", "决定", "偏好", "记住", "以后", "不要",
)
KIND_TO_TYPE = {
    "decision": "project", "constraint": "feedback", "summary": "project",
    "preference": "user", "blocker": "project", "memory": "reference",
}
NOTE_RULES = (
    ("constraint", 0.92, ("must not", "must ", "never", "cannot", "can't", "avoid", "limit", "constraint", "required", "require",
                          "do not", "don't", "必须", "务必", "一定要", "不能", "不要", "禁止", "避免", "限制", "约束", "要求")),
    ("decision", 0.88, ("recommend", "should", "best", "choose", "decide", "decision", "prefer",
                        "建议", "推荐", "应该", "最好", "选择", "决定")),
    ("preference", 0.84, ("prefer", "like", "favorite", "favourite", "want", "rather", "偏好", "喜欢", "希望", "想要", "倾向")),
    ("blocker", 0.8, ("blocked", "problem", "issue", "risk", "bug", "failure", "error", "问题", "风险", "错误", "失败", "缺陷", "阻塞")),
    ("summary", 0.76, ("in summary", "to sum up", "overall", "key point", "key points", "summary", "总结", "概括", "要点", "重点", "结论")),
    ("memory", 0.82, ("remember", "keep in mind", "note that", "long-term", "for later", "记住", "记忆", "以后", "后续", "长期", "留意")),
)
NOTE_SUMMARY_WORDS = ("important", "key", "crucial", "stable", "always", "must", "重要", "关键", "核心", "稳定", "总是", "必须")
CACHE_THRESHOLD = 0.92

# ---- evaluation ----------------------------------------------------------------
SYNONYMS = {
    "retrieval": ("检索", "召回"),
    "retrieve": ("检索", "召回"),
    "context": ("上下文",),
    "compress": ("压缩", "裁剪"),
    "history": ("历史",),
    "document": ("文档",),
    "note": ("笔记", "记忆"),
    "notes": ("笔记", "记忆"),
    "constraint": ("约束", "限制"),
    "rag": ("rag", "检索增强"),
    "search": ("搜索",),
    "time": ("时间",),
    "evidence": ("证据", "依据"),
    "keyword": ("关键词", "关键字"),
    "evaluation": ("评估", "评价"),
    "metric": ("指标", "度量"),
    "benchmark": ("基准",),
    "analysis": ("分析",),
    "summary": ("总结", "摘要"),
    "filter": ("过滤", "筛选"),
    "ranking": ("排序", "排名"),
    "boost": ("提升", "加权"),
}
SCORE_WEIGHTS = {
    "route_correct": 0.20, "tool_correct": 0.10, "tool_args_correct": 0.05, "keyword_hit": 0.15, "evidence_hit": 0.10,
    "must_include_hit": 0.15, "must_not_include_hit": 0.10, "notes_used": 0.10, "context_mode_correct": 0.05,
}
PASS_SCORE, HIGH_TOKENS, HIGH_LATENCY_MS = 0.75, 8000, 60000
PROMPT_TOKEN_NAMES = ("prompt_tokens", "input_tokens", "input_token_count", "prompt_token_count")
COMPLETION_TOKEN_NAMES = ("completion_tokens", "output_tokens", "output_token_count", "completion_token_count")
TOTAL_TOKEN_NAMES = ("total_tokens", "total_token_count")
SENSITIVE_KEYS = ("api_key", "apikey", "token", "password", "secret", "authorization")
DEBUG_NODES = ("planning", "judge", "expand", "branch_gather", "branch_synthesize")
DEBUG_NAMES = ("clarify", "refine_query", "judge", "expand", "branch_gather", "branch_synthesize")

# ---- guards --------------------------------------------------------------------
# (name, pattern, risk)
INJECTION_RULES = (
    ("override", r"(?i)\b(ignore|disregard)\b.{0,30}\b(previous|above|prior|system)\b.{0,30}(instruction|prompt|rule|message)", 0.9),
    ("forget", r"(?i)\bforget\s+(all|your|previous)\b", 0.85),
    ("role", r"(?i)\byou\s+are\s+(now|actually)\b", 0.8),
    ("act_as", r"(?i)\bact\s+as\s+(if|a)\b.{0,20}(admin|root|developer|system)", 0.85),
    ("as_assistant", r"(?i)\bas\s+an?\s+(ai|assistant)\b.{0,30}\b(call|invoke|use|execute)\b.{0,20}(tool|function|command)", 0.8),
    ("eval", r"(?i)\b(eval|exec)\s*\(", 0.95),
    ("shell", r"(?i)\b(sub?_?process|os\.system|os\.popen|/bin/sh|/bin/bash)\b", 0.95),
    ("credential", r"(?i)\b(api_key|api_secret|token|secret|password|authorization)\s*[:=]\s*\S", 0.7),
    ("output_order", r"(?i)\b(ignore|disregard).{0,20}(result|output|above).{0,20}(and|then|please).{0,30}(call|invoke|use|send)", 0.9),
)
INSTRUCTION_WORDS = r"(?i)\b(please|must|should|require|important|notice|warning)\b"
FILTERED = "[filtered: possible injection]"
WEB_NOISE = (
    "Open in app", "Sign in", "Write", "Search", "Listen", "Privacy", "Terms", "Help", "Status", "Careers", "Blog", "Text to speech",
)

# ---- pages -----------------------------------------------------------------------
# hidden blocks (to their end tag, or to the end), comments and declarations
HTML_HIDDEN = (
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", r"(?is)<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)",
    r"(?s)<!--.*?-->", r"<![^>]*>",
)
HTML_BREAK = r"(?i)<(?:p|br|div|section|article|h1|h2|h3|li)(?:[\s/][^>]*)?>|</(?:p|div|section|article|li)\s*>"
HTML_TAG = r"</?[A-Za-z][^>]*>"
HTML_NUMBER = r"&#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"
# named character references; the ampersand itself is resolved last
HTML_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "deg": "°", "sect": "§", "para": "¶",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "times": "×", "divide": "÷", "plusmn": "±", "frac12": "½", "auml": "ä", "ouml": "ö", "uuml": "ü",
    "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ntilde": "ñ",
    "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
}
