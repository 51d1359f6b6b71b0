"""Dictionaries, patterns, tables and weights that results depend on."""

from __future__ import annotations

# Unsafe words by category, in order.
UNSAFE = {
    "violence": ["制造炸弹", "爆炸物配方", "毒气合成", "自制武器", "生化武器", "暗杀教程", "伤害他人", "人身攻击方法"],
    "illegal": ["制毒方法", "冰毒合成", "贩毒渠道", "洗钱教程", "诈骗脚本", "黑产变现", "非法入侵", "盗取账号"],
    "privacy": ["身份证号泄露", "银行卡信息", "开房记录查询", "人肉搜索", "个人隐私数据库", "手机号实名查询"],
    "political_sensitive": ["颠覆政府", "武装暴乱", "分裂国家"],
    "spam": ["加微信返利", "日赚万元", "内部消息炒股", "一夜暴富", "免费领取红包", "点击链接领奖", "私聊发链接"],
}

# Words of the text scenes.
TEXT_WORDS = {
    "medical_sft": [
        "患者", "诊断", "治疗", "医嘱", "症状", "体征", "处方", "病历", "临床", "手术", "检查", "血压", "心率", "血糖", "药物", "剂量", "肿瘤", "并发症", "预后", "病理", "禁忌症", "CT", "MRI",
        "化疗", "放疗", "静脉", "patient", "diagnosis", "treatment", "clinical", "symptom", "prescription", "dosage", "pathology", "prognosis",
        "contraindication",
    ],
    "legal_doc": [
        "合同", "条款", "甲方", "乙方", "违约", "仲裁", "判决", "诉讼", "原告", "被告", "赔偿", "协议", "权利", "义务", "法律", "法规", "履行", "解除", "终止", "保密", "知识产权", "担保", "保证金",
        "不可抗力", "contract", "clause", "breach", "arbitration", "plaintiff", "defendant", "statute", "liability", "jurisdiction",
    ],
    "code_tech": [
        "函数", "变量", "接口", "数据库", "算法", "框架", "API", "SDK", "bug", "debug", "部署", "架构", "优化", "function", "class", "algorithm", "database",
        "deployment",
    ],
    "creative": [
        "故事", "小说", "诗歌", "散文", "情节", "人物", "叙述", "描写", "主人公", "情感", "意象", "隐喻", "比喻", "幻想", "章节", "结局", "narrative", "protagonist", "metaphor",
        "prose", "lyric",
    ],
    "chat_qa": ["请问", "如何", "什么是", "为什么", "怎么", "帮我", "解释", "question", "answer", "explain"],
}

# Patterns of the text scenes.
TEXT_PATTERNS = {
    "medical_sft": [r"(?i)\d+\s*(?:mg|ml|g|mmol|μg|IU)(?:/\w+)?", r"(?:用法|用量|注意事项|不良反应|适应症|禁忌症)[：:]", r"\b(?:ICD|SNOMED|qd|bid|tid|qid|iv|po|im)\b"],
    "legal_doc": [r"第[一二三四五六七八九十百\d]+条", r"[甲乙丙]方", r"\d{4}年\d{1,2}月\d{1,2}日"],
    "code_tech": [r"def\s+\w+\s*\(", r"function\s+\w+\s*[\({]", r"class\s+\w+[\s:{(]", r"import\s+[\w.]+", r'#include\s*[<"]', r"```[\w]*\n", r"\b(HTTP|SQL|JSON|REST|gRPC|OAuth|async|await|SELECT|INSERT|CREATE TABLE)\b"],
    "creative": [r"[\x{201c}\x{201d}\x{300c}\x{300d}].{4,}[\x{201c}\x{201d}\x{300c}\x{300d}]", r"[\x{4e00}-\x{9fa5}]{4,}\x{2026}\x{2026}", r"[\x{4e00}-\x{9fa5}]{3,}[，。？！][\x{4e00}-\x{9fa5}]{3,}"],
    "chat_qa": [r"[问Q][：:].{5,}", r"[答A][：:].{10,}"],
}

# Weights of words and patterns in a text scene's score.
TEXT_MIX = {"medical_sft": (0.60, 0.40), "legal_doc": (0.60, 0.40), "code_tech": (0.35, 0.65), "creative": (0.55, 0.45), "chat_qa": (0.40, 0.60)}

# Words of the image scenes; upper-case ones never match lower-cased text.
IMAGE_WORDS = {
    "illustration": [
        "插画", "绘画", "画作", "原创", "艺术", "赛博朋克", "二次元", "动漫", "概念图", "设定图", "原画", "数字绘画", "CG", "奇幻", "机甲", "蒸汽朋克", "水彩", "油画", "素描", "手绘",
        "illustration", "artwork", "painting", "digital art", "concept art", "anime", "manga", "character design", "cyberpunk", "fantasy",
        "watercolor", "oil painting", "sketch", "portrait", "sci-fi", "4k", "8k",
    ],
    "photo": ["照片", "摄影", "拍摄", "实拍", "风景", "人像", "街拍", "纪实", "photo", "photograph", "camera", "shot", "portrait", "landscape"],
    "screenshot": ["截图", "截屏", "界面", "UI", "屏幕", "桌面", "浏览器", "网页", "screenshot", "screen capture", "interface", "desktop", "browser"],
    "diagram": [
        "图表", "流程图", "架构图", "示意图", "数据可视化", "折线图", "柱状图", "饼图", "拓扑图", "UML", "diagram", "chart", "flowchart", "architecture", "visualization",
        "graph", "infographic",
    ],
}

# Words of the audio scenes.
AUDIO_WORDS = {
    "speech_medical": [
        "患者", "诊断", "病历", "手术", "检查", "医嘱", "临床", "治疗", "症状", "用药", "medical", "patient", "diagnosis", "clinical", "surgery", "prescription",
        "hospital", "doctor", "physician", "radiology", "oncology",
    ],
    "speech_legal": [
        "合同", "庭审", "判决", "陈述", "证词", "仲裁", "法庭", "律师", "庭上", "被告", "原告", "court", "testimony", "verdict", "plaintiff", "defendant", "hearing",
        "legal", "attorney", "deposition", "proceedings", "counsel",
    ],
    "speech_edu": [
        "课程", "教学", "讲解", "学生", "培训", "讲座", "授课", "解释", "辅导", "course", "lecture", "tutorial", "teaching", "student", "education", "lesson",
        "explain", "class", "workshop", "seminar",
    ],
    "music_original": [
        "音乐", "旋律", "节奏", "歌曲", "演奏", "歌词", "乐器", "编曲", "配乐", "原创", "music", "melody", "rhythm", "song", "instrument", "beat", "chord", "lyric",
        "composition", "track", "recording", "album", "vocalist", "guitar", "piano",
    ],
}

# Words of the video scenes and of video noise.
VIDEO_WORDS = {
    "documentary": [
        "纪录片", "采访", "庭审", "专题", "调查", "新闻", "访谈", "报道", "documentary", "interview", "investigation", "report", "coverage", "court", "witness",
        "journalism", "investigative",
    ],
    "lecture": [
        "教学", "讲课", "课程", "授课", "演讲", "培训", "教程", "讲解", "讲座", "tutorial", "lecture", "course", "lesson", "teaching", "class", "how-to", "guide",
        "webinar", "presentation", "keynote",
    ],
    "cinematic": [
        "电影", "影片", "故事片", "短片", "剪辑", "预告", "mv", "music video", "电影级", "4k", "8k", "uhd", "hdr", "raw", "log", "dolby", "航拍", "cinematic", "film",
        "movie", "short film", "trailer", "color grade", "anamorphic", "drone", "aerial", "bokeh", "steadicam",
    ],
    "sports_action": [
        "运动", "体育", "比赛", "篮球", "足球", "跑步", "健身", "训练", "竞技", "极限", "滑板", "攀岩", "跑酷", "动作", "sports", "basketball", "football", "running", "fitness",
        "workout", "action", "extreme", "skateboard", "climbing", "parkour", "race",
    ],
    "vlog": [
        "vlog", "日常", "记录", "生活", "旅行", "美食", "探店", "分享", "review", "开箱", "unboxing", "haul", "daily", "lifestyle", "travel", "food", "react",
        "mukbang", "prank", "challenge",
    ],
}
VIDEO_NOISE = ["测试", "test", "loop", "repeated", "random", "noise", "blank", "empty", "黑屏", "乱码", "无效", "静音", "static"]

# Demand and slope of each scene's bonding curve.
CURVE = {
    "medical_sft": (28, 32), "legal_doc": (18, 28), "code_tech": (15, 22), "creative": (8, 18), "chat_qa": (10, 15), "illustration": (22, 20), "photo": (6, 14), "diagram": (5, 10), "screenshot": (2, 6), "speech_medical": (28, 38), "speech_legal": (22, 32),
    "speech_edu": (15, 20), "music_original": (18, 22), "ambient_sfx": (8, 14), "general": (5, 25), "noise": (0, 0), "documentary": (24, 36), "lecture": (20, 30), "cinematic": (18, 26), "sports_action": (10, 18), "vlog": (5, 12),
}

# Multipliers of scenes, value units of modalities.
MULTIPLIER = {
    "medical_sft": 1.35, "legal_doc": 1.20, "code_tech": 1.10, "creative": 0.90, "chat_qa": 0.80, "noise": 0.05, "illustration": 1.5, "photo": 1.0, "screenshot": 0.25, "diagram": 0.55, "documentary": 1.40, "lecture": 1.30, "cinematic": 1.20, "sports_action": 0.90, "vlog": 0.65,
}
UNITS = {"text": 1.0, "image": 50.0, "audio": 120.0, "video": 500.0}

# Weights of entropy, snr, structure, scarcity, llm_value and shapley by scene.
DIMENSIONS = ("entropy", "snr", "structure", "scarcity", "llm_value", "shapley")
WEIGHTS = {
    "medical_sft": (0.25, 0.30, 0.20, 0.10, 0.10, 0.05), "legal_doc": (0.15, 0.20, 0.35, 0.15, 0.10, 0.05), "code_tech": (0.10, 0.20, 0.40, 0.10, 0.15, 0.05), "creative": (0.35, 0.10, 0.15, 0.25, 0.05, 0.10), "chat_qa": (0.20, 0.15, 0.15, 0.15, 0.25, 0.10),
    "noise": (0.20, 0.20, 0.20, 0.20, 0.10, 0.10), "illustration": (0.15, 0.10, 0.40, 0.20, 0.10, 0.05), "photo": (0.30, 0.15, 0.20, 0.20, 0.10, 0.05), "screenshot": (0.25, 0.25, 0.20, 0.15, 0.10, 0.05), "diagram": (0.20, 0.15, 0.30, 0.20, 0.10, 0.05),
    "documentary": (0.20, 0.25, 0.25, 0.15, 0.10, 0.05), "lecture": (0.25, 0.20, 0.20, 0.15, 0.15, 0.05), "cinematic": (0.20, 0.30, 0.25, 0.10, 0.10, 0.05), "sports_action": (0.30, 0.15, 0.30, 0.10, 0.10, 0.05), "vlog": (0.25, 0.20, 0.20, 0.15, 0.15, 0.05),
    "speech_medical": (0.15, 0.35, 0.20, 0.15, 0.10, 0.05), "speech_legal": (0.15, 0.30, 0.25, 0.15, 0.10, 0.05), "speech_edu": (0.20, 0.25, 0.20, 0.15, 0.15, 0.05), "music_original": (0.25, 0.20, 0.25, 0.15, 0.10, 0.05), "ambient_sfx": (0.30, 0.20, 0.20, 0.15, 0.10, 0.05),
}

# Shapes of the contribution weighting by scene; other scenes have (2, 1).
SHAPES = {"medical_sft": (4.0, 1.0), "legal_doc": (4.0, 1.0), "code_tech": (3.0, 1.0), "creative": (2.0, 2.0), "chat_qa": (2.0, 2.0), "illustration": (3.0, 2.0), "photo": (3.0, 2.0), "diagram": (2.0, 1.5), "screenshot": (1.5, 1.5), "noise": (1.0, 1.0)}

# Contribution weights of tiers and kinds of samples.
TIER_WEIGHT = {"platinum": 3.0, "gold": 2.0, "silver": 1.0, "rejected": 0.0}
KIND_WEIGHT = {"sft": 1.5, "dpo": 1.8, "pretrain": 0.8}

# Sentences of rule annotation, and how instructions may start.
ASK_SFT, ASK_DPO, REFUSAL = "请分析并总结以下内容：", "关于以下内容，给出专业分析：", "此问题较为复杂，需要更多背景信息才能回答。"
VERBS = ("请", "如何", "分析", "描述", "解释", "写", "生成", "总结")

# Progress of a job by stage.
PROGRESS = {"pending": 0, "safety": 20, "annotation": 50, "scoring": 70, "dedup": 85, "packaging": 95, "done": 100, "failed": 0}

# Issues of samples, and the words in them by which they count.
EMPTY, SHORT, PREFERENCE, SIMILAR = "为空", "过短", "偏好", "相似"
SFT_ISSUES = {"empty": "instruction 为空", "short": "instruction 过短（<5字）", "short_output": "output 过短（<10字）", "no_letters": "内容无可辨识语言字符"}
DPO_ISSUES = {"same": "chosen 与 rejected 完全相同，无偏好信号", "alike": ("chosen 与 rejected 过于相似（字符重叠 ", "%），偏好信号弱")}

# Fixed value: alignment of a text where there are no prototypes.
UNALIGNED = 50.0

# The rule's confidence that decides a text's scene alone, and shares of rule and anchors below it.
SURE, RULE_SHARE, ANCHOR_SHARE = 0.42, 0.4, 0.6
