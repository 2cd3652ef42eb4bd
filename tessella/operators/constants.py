"""Fixed values of the data model: relations, weights, types, keywords, templates. All are defaults of arguments."""

from __future__ import annotations

#: Relation weights; an unknown relation weighs 0.5.
RELATION_WEIGHTS = {
    "recommand_drug": 1.0,
    "has_symptom": 0.95,
    "common_drug": 0.9,
    "cure_way": 0.9,
    "need_check": 0.85,
    "no_eat": 0.85,
    "do_eat": 0.8,
    "drugs_of": 0.8,
    "recommand_eat": 0.75,
    "acompany_with": 0.7,
    "belongs_to": 0.6,
}
#: Display names of relations.
RELATION_NAMES = {
    "has_symptom": "有症状",
    "recommand_drug": "推荐药品",
    "common_drug": "常用药品",
    "need_check": "需要检查",
    "cure_way": "治疗方法",
    "do_eat": "宜吃",
    "no_eat": "忌吃",
    "recommand_eat": "推荐食用",
    "acompany_with": "伴随",
    "belongs_to": "属于",
    "drugs_of": "药品所属",
}
#: The relations that an entity type has; other types have none.
TYPE_RELATIONS = {
    "Disease": ["has_symptom", "recommand_drug", "common_drug", "need_check", "cure_way", "do_eat", "no_eat", "acompany_with", "belongs_to"],
    "Drug": ["drugs_of"],
    "Department": ["belongs_to"],
    "Producer": ["drugs_of"],
}
#: Priorities of mention types, and the type that a dictionary file name stands for.
TYPE_PRIORITY = {"Drug": 10, "Disease": 9, "Symptom": 8, "Check": 7, "Food": 6, "Department": 5, "Producer": 4, "Deny": 1}
FILE_TYPES = {name.lower(): name for name in ("Disease", "Drug", "Food", "Check", "Department", "Producer", "Symptom", "Deny")}
SOURCE_PRIORITY = {"keyword": 3, "ner": 2, "llm": 1}
#: Raw tags of the mention model and their types; other tags mean Disease.
MODEL_TYPES = {
    "dis": "Disease", "sym": "Symptom", "pro": "Check", "equ": "Check", "ite": "Check", "dru": "Drug", "bod": "Symptom", "dep": "Department", "mic": "Disease",
    "disease": "Disease", "drug": "Drug", "food": "Food", "check": "Check", "department": "Department", "producer": "Producer", "symptom": "Symptom",
}
#: Type names in answers of a language model.
ANSWER_TYPES = {"疾病": "Disease", "药品": "Drug", "药物": "Drug", "症状": "Symptom", "食物": "Food", "检查": "Check", "科室": "Department", "生产商": "Producer", "否定": "Deny"}
#: Keywords of each intent, in order of declaration.
INTENT_KEYWORDS = {
    "symptom_inquiry": ["症状", "不舒服", "难受", "疼痛", "怎么办", "发热", "咳嗽", "头痛"],
    "disease_inquiry": ["病", "疾病", "症", "炎", "是什么", "为什么", "感冒", "肺炎", "高血压"],
    "medication_inquiry": ["药", "药品", "药物", "治疗", "吃什么", "能吃吗", "布洛芬", "阿莫西林"],
    "examination_inquiry": ["检查", "化验", "体检", "血常规", "尿常规"],
    "diet_lifestyle": ["吃", "饮食", "食物", "注意", "能吃吗", "低盐", "低脂"],
    "other": ["科", "科室", "挂号", "医院"],
}
#: Labels of the intent model and the intents they stand for.
MODEL_INTENTS = {
    "病情诊断": "symptom_inquiry",
    "疾病表述": "disease_inquiry",
    "病因分析": "disease_inquiry",
    "后果表述": "disease_inquiry",
    "治疗方案": "medication_inquiry",
    "功效作用": "medication_inquiry",
    "注意事项": "diet_lifestyle",
    "指标解读": "examination_inquiry",
    "就医建议": "other",
    "医疗费用": "other",
    "其他": "other",
}
#: Intent -> (relations, hops, prompt); no relations means those of the entities' types.
INTENT_TEMPLATES = {
    "symptom_inquiry": (["has_symptom", "acompany_with", "recommand_drug", "cure_way"], 1, "根据查询的症状，以下是相关的医疗知识：\n{knowledge}"),
    "disease_inquiry": (["has_symptom", "recommand_drug", "common_drug", "need_check", "cure_way", "do_eat", "no_eat", "acompany_with"], 2, "关于{entity}，以下是相关的医疗知识：\n{knowledge}"),
    "medication_inquiry": (["recommand_drug", "common_drug", "drugs_of", "cure_way"], 1, "关于用药咨询，以下是相关的医疗知识：\n{knowledge}"),
    "examination_inquiry": (["need_check"], 1, "关于检查咨询，以下是相关的医疗知识：\n{knowledge}"),
    "diet_lifestyle": (["do_eat", "no_eat", "recommand_eat"], 1, "关于饮食和生活注意事项，以下是相关的医疗知识：\n{knowledge}"),
    "other": ([], 1, "以下是相关的医疗知识：\n{knowledge}"),
}
#: Relations that a section of a document speaks of.
SECTION_RELATIONS = {
    "分类路径": ["belongs_to"],
    "常见症状": ["has_symptom"],
    "并发疾病": ["acompany_with"],
    "推荐检查": ["need_check"],
    "治疗方案": ["cure_way"],
    "临床推荐用药": ["recommand_drug"],
    "常用辅助药物": ["common_drug"],
    "饮食宜吃": ["do_eat"],
    "饮食禁忌": ["no_eat"],
    "推荐食谱": ["recommand_eat"],
    "疾病简介": ["desc"],
    "发病原因": ["cause"],
    "预防措施": ["prevent"],
}
#: Sections that say nothing.
EMPTY_SECTIONS = ["暂无", "暂无相关信息", "（暂无）", "暂无相关"]
#: Labels and their headings in a generated description.
LABEL_HEADINGS = {"Disease": "相关疾病", "Symptom": "相关症状", "Drug": "推荐药品", "Check": "相关检查", "Food": "相关食物"}
#: Vague words, which route a question to the model where no mention is near.
VAGUE_WORDS = ["感觉", "觉得", "有点", "总是", "经常", "有时候"]
#: Words of a complex question, which route it to the language model.
COMPLEX_WORDS = ["老是", "经常", "有时候", "偶尔", "有点", "比较", "特别", "非常", "好像", "似乎", "可能", "大概"]
#: Question words; two or more route to the language model.
QUESTION_WORDS = ["吗", "呢", "什么", "怎么", "如何", "哪里", "为什么"]
#: Colloquial phrases, which route to the language model.
COLLOQUIAL = ["不太舒服", "感觉不对劲", "不知道怎么回事", "该怎么办"]
