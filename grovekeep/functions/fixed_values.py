"""Lists, labels and constants that results depend on."""

# --- fixed values: recall scheduling ---------------------------------------
START_DIFFICULTY = 0.3
DIFFICULTY_FLOOR = 0.01
DIFFICULTY_CEILING = 1.0
DIFFICULTY_RATE = 0.15
FIRST_STABILITY = {1: 0.5, 2: 1.0, 3: 2.0, 4: 4.0}
STABILITY_FACTOR = {1: 0.5, 2: 1.3, 3: 2.5, 4: 4.0}
LAPSE_STABILITY_FLOOR = 0.5
INTERVAL_FACTOR = 0.10536
SECONDS_PER_DAY = 86400
LAST_SECOND = 253402300799.0
RATING_CORRECT = 3
RATING_WRONG = 1

# --- fixed values: topic tags -----------------------------------------------
DOMAIN_KEYWORDS = {
    "日本文化": ["日本", "动漫", "漫画", "樱花", "东京", "日语", "二次元", "anime", "manga", "和风", "武士", "忍者", "京都"],
    "编程技术": ["python", "javascript", "c语言", "java", "api", "算法", "数据库", "vue", "react", "代码", "编程", "开发", "css", "html", "sql", "nlp", "机器学习"],
    "自然科学": ["物理", "化学", "生物", "数学", "天文", "地理", "实验", "公式", "定理"],
    "文学艺术": ["文学", "诗", "小说", "绘画", "音乐", "美术", "电影", "艺术", "哲学"],
    "历史人文": ["历史", "文化", "政治", "经济", "社会", "古代", "近代"],
    "语言学习": ["英语", "德语", "法语", "西班牙语", "单词", "语法", "翻译"],
}
OTHER_TAG = "其他"
STYLE_RULES = [("日本文化", 0.30, "sakura"), ("编程技术", 0.40, "cyberpunk"), ("文学艺术", 0.30, "ink")]
DEFAULT_STYLE = "default"

# --- fixed values: question bank ---------------------------------------------
TYPE_LABELS = {"single_choice": "单选题", "true_false": "判断题", "short_answer": "简答题"}
DEFAULT_TYPE_LABEL = "单选题"
TRUE_FALSE_CHOICES = ["正确", "错误"]
DEFAULT_QUESTION_DIFFICULTY = "medium"
FENCED_BLOCK = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
PROMPT_NAME = "知识点名称："
PROMPT_CONTENT = "内容："
PROMPT_SEPARATOR = "\n---\n"
PROMPT_TYPES_HEAD = "题目类型要求：请生成"
PROMPT_TYPES_TAIL = "。\n\n"
PROMPT_TYPES_JOIN = "、"

# --- fixed values: generated nodes --------------------------------------------
DUPLICATE_NAME_SUFFIX = "（补充）"

# --- fixed values: learner statistics ------------------------------------------
GROWTH_STAGES = [
    (0.3, 2.0, "萌芽阶段 · 持续积累"),
    (0.6, 5.0, "生长阶段 · 稳步推进"),
    (0.9, 15.0, "繁茂阶段 · 知识扎根"),
]
GROWTH_STAGE_NONE = "种子阶段 · 开始学习吧"
GROWTH_STAGE_FULL = "参天大树 · 学识深厚"
STABILITY_UNSEEN = "未复习"
STABILITY_HOURS = "小时"
STABILITY_DAYS = "天"
STABILITY_MONTHS = "月"
SIZE_TIER_BOUNDS = [20, 80, 300]
DEFAULT_LIMIT = 20
WEAK_LIMIT = 5
