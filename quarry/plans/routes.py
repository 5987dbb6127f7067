"""Queries of EXP-16 and EXP-17. The SQL states its patterns by itself, as regular expressions in the usual form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import routing as ro

from .registry import query

DEVICES, METRICS = ["AX-7", "K50"], ["K50"]

#: White space, and the patterns of each kind of question.
BLANK = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PATTERNS = {
    "corpus": r"文档|知识库|故障库|资料库|源文件|源文档",
    "quantity": r"多少[篇份个]|几[篇份个]|数量|总数|总量|统计|概况|概览|(文档|知识库|故障库|资料库|源文件|源文档)(里|中|的|当前|现在|目前|总共|一共|总计|共有|有|是|为)*多少([？?。！!]|BLANK|$)",
    "casual": r"^((你|您)?好(呀|啊|哈)?|hi|hello|hey|嗨|哈喽|在吗|谢谢|多谢|感谢|辛苦了|好的?|ok|okay|收到|明白(了)?|再见|拜拜|bye|你是谁|您是谁|你能做什么|你会什么|介绍一下你自己)$",
    "low_value": r"(回答|答复|回复|答案|结论).*(确定|确认|肯定).*(对|正确|准确|靠谱吗|可靠|没问题)|(确定|确认|肯定).*(回答|答复|回复|答案|结论)|(回答|答案|结论).*(对吗|正确吗|准确吗|靠谱吗|可靠吗|确定吗)"
    r"|^(真的吗|真的假的|确定吗|对吗|靠谱吗|可靠吗)$|胡说|瞎说|乱说|乱答|瞎答|骗我|忽悠我|(这个|这答案|你说的).*(能信|可信吗|靠得住吗|有谱吗)",
    "low_value_not": r"两次|上次|这次|前后|第一(次)?|第二(次)?|不一样|不同|差异|比较|引用|文档|图片|依据|来源|检索|召回|trace|日志|为什么|为啥|怎么",
    "reanswer": r"(重新|再|重新再|再重新).*(回答|解答|说|讲|生成)|(回答|解答).*(刚才|上面|上边|之前|我的).*(问题)",
    "reanswer_not": r"检查|核对|审查|反思|复盘|依据|来源|为什么|为啥|不一样|不同|差异|图片|引用|文档",
    "audit": r"(为什么|为啥|怎么).*(两次|这次|上次|前后|第一次|第二次|刚才|之前).*(不一样|不同|区别|差异)|(为什么|为啥|怎么).*(图片|回答|答案|引用|文档).*(不一样|不同|变了|换了|差异)"
    r"|(刚才|上次|前面|之前|第一次|第二次).*(依据|来源|引用|为什么|错|不对|检查|核对|反思)|(重新|再)(检查|核对|审查|反思)|(回答|答案|图片|引用|文档).*(依据|来源|为什么|不一样|不同|差异)",
    "feedback": r"(回答|答复|回复).*(不对|不准|不准确|不好|有问题|错了|错误)|(不对|不准|不准确|不好|错了|错误).*(回答|答复|回复)|投诉|反馈|差评|不满意|很差|太差|胡说|乱说|瞎说",
    "emotional": r"(回答|答复|回复|答案|结论).*(不对|不准|不准确|不好|有问题|错了|错误|很差|太差|离谱|胡说|乱说|瞎说)|(不对|不准|不准确|不好|错了|错误|很差|太差|离谱|胡说|乱说|瞎说).*(回答|答复|回复|答案|结论)"
    r"|投诉|反馈|差评|抱怨|吐槽|不满意|很差|太差|离谱|胡说|乱说|瞎说|无语|糟糕"
    r"|(设备|仪器|机器|产品|系统|测序仪|测序设备|测序平台).*(问题|故障|毛病|异常|报错|坏|出问题).*(多|很多|好多|不少|严重|频繁|经常|老是|总是|容易|无语|离谱|糟糕|很差|太差)"
    r"|(设备|仪器|机器|产品|系统|测序仪|测序设备|测序平台).*(不稳定|质量差|不可靠|不靠谱|靠不住|经常坏|老坏|总坏)",
    "emotional_not": r"怎么|如何|怎样|怎么办|为什么|为啥|原因|有哪些|列举|常见|清单|排查|检查|处理|解决|修复|维修|维护|步骤|操作|参数|手册|说明书|文档|知识库|阈值|范围|方案|对策|流程|SOP|统计|故障率|问题率|对比|比较",
    "vague": r"(设备|仪器|机器|产品|系统).*(问题|故障|毛病|异常|报错|坏|出问题).*(多|很多|好多|不少|严重|频繁|经常|老是|总是|容易|故障率|问题率|稳定|可靠|靠谱|质量|是不是|是否)"
    r"|(设备|仪器|机器|产品|系统).*(多|很多|好多|不少|严重|频繁|经常|老是|总是|容易|是不是|是否).*(问题|故障|毛病|异常|报错|坏|出问题)"
    r"|(设备|仪器|机器|产品|系统).*(质量|稳定性?|可靠性?|故障率|问题率).*(怎么样|如何|好吗|高吗|低吗|靠谱吗|可靠吗|稳定吗|吗|嘛)|(设备|仪器|机器|产品|系统).*(靠谱吗|可靠吗|稳定吗|质量怎么样|容易坏吗)"
    r"|(你们|你这边|你这里|你们的|贵司|厂家).*(设备|仪器|机器|产品|系统).*(有)?(问题|故障|毛病|异常|报错|坏|出问题).*(吗|嘛)",
    "vague_not": r"怎么|如何|怎样|怎么办|有哪些|列举|常见|清单|排查|处理|解决|修复|维修|维护|步骤|操作|参数|手册|说明书|文档|知识库|阈值|范围|方案|对策|流程|SOP",
    "reference": r"上面|上边|上文|前面|之前|刚才|刚刚|上一(个|条|轮)|前一(个|条|轮)|相关问题|这个问题|那个问题|该问题|此问题|这个故障|那个故障",
    "follow_up": r"解决方案|解决办法|处理方法|怎么解决|怎么处理|怎么办|原因|为什么|排查|检查步骤|操作步骤|步骤|再(给我)?(说|讲|解释|总结)(一下)?|重新(说|讲|解释)|详细(说|讲|解释)|展开(说|讲)?",
    "tool": r"(查|查询|看|获取)(一下)?(今天|明天|未来|近|最近).*(天气|气温|汇率|航班|快递|股票)|(调用|执行|运行|发送|创建|删除|更新).*(API|接口|工具|MCP|邮件|工单)",
    "ambiguous": r"^((这个|那个|它|上面那个)(怎么用|怎么处理|怎么办|是什么)?|怎么弄|怎么办|帮我看看|不行了|有问题)$",
    "knowledge": r"知识库|RAG|文档|手册|说明书|故障|报错|异常|报警|原因|排查|维修|维护|修复|解决|操作|步骤|参数|阈值|范围|设备|仪器|试剂|测序|芯片|Q30|ECR|AX-7|K50|FIT|NSB|SBC|DNQ|Cycle|PE|HeatMap|热图|Lag/Runon|Spiking"
    r"|FineAlign|GetQCAndEndCycleTime|ConfigList|FOVMetrics|VerifyStageFlatness|report_check|picture_check",
    "code": r"(error|err)(BLANK|[:_-])*[a-z0-9_-]|[A-Z]{1,5}[-_]?[0-9]{2,}([^a-z0-9]|$)",
    "metric": r"(^|[^\pL\pN_])(Q30|ECR|FIT|NSB|SBC|DNQ|K50)([^\pL\pN_]|$)",
    "complex": r"结合|综合|对比|比较|复盘|重新检查|完整分析|根因|定位|多份|多个|图片|图像|照片|日志|报表|曲线|数据|原因.*解决|解决.*原因|先.*再|一步步|详细排查",
}
PATTERNS = {k: p.replace("BLANK", BLANK) for k, p in PATTERNS.items()}
_IS = {k: f"regexp_matches({'raw' if k in ('corpus', 'quantity', 'code', 'metric') else 'tx'}, '(?is){p}')" for k, p in PATTERNS.items()}

ROUTED = f"""q0 as (select *, regexp_replace(coalesce(question, ''), '^{BLANK}+|{BLANK}+$', '', 'g') as raw from {{questions}}),
q1 as (select *, regexp_replace(regexp_replace(raw, '{BLANK}+', '', 'g'), '[。！？!?,，.、~～；;：:]+$', '') as tx from q0),
q2 as (select *, {_IS["code"]} or {_IS["metric"]} as named, {_IS["reference"]} and {_IS["follow_up"]} as follows from q1),
q3 as (select *, case when {_IS["corpus"]} and {_IS["quantity"]} then 1 when has_images then 2 when tx = '' then 3 when {_IS["casual"]} then 4
  when {_IS["low_value"]} and not {_IS["low_value_not"]} then 5 when {_IS["reanswer"]} and not {_IS["reanswer_not"]} and not follows then 6 when {_IS["audit"]} then 7 when {_IS["feedback"]} then 8
  when not named and {_IS["emotional"]} and not {_IS["emotional_not"]} then 9 when not named and {_IS["vague"]} and not {_IS["vague_not"]} then 10
  when {_IS["tool"]} then 11 when follows then 12 when {_IS["ambiguous"]} then 13 when {_IS["knowledge"]} then 14 else 15 end as rule from q2),
routed as (select *, ['knowledge_statistics', 'knowledge_search', 'clarify', 'casual_chat', 'casual_chat', 'knowledge_search', 'answer_audit', 'emotional_feedback', 'emotional_feedback', 'emotional_feedback', 'tool_call', 'knowledge_search', 'clarify', 'knowledge_search', 'knowledge_search'][rule] as route,
  ['knowledge_statistics', 'uploaded_image', 'empty_question', 'casual_pattern', 'low_value_feedback', 'contextual_retry', 'answer_audit_pattern', 'feedback_pattern', 'emotional_feedback_pattern', 'vague_domain_chat', 'tool_pattern', 'contextual_followup', 'ambiguous_reference', 'knowledge_signal', 'no_match'][rule] as reason,
  [0.99, 0.99, 1.0, 0.98, 0.97, 0.97, 0.97, 0.97, 0.97, 0.96, 0.95, 0.96, 0.92, 0.94, 0.0][rule]::double as confidence from q3)"""


def _routed():
    return ro.route_questions(F.col("question"), F.col("has_images"), devices=DEVICES, metrics=METRICS)


@query("exp16_routes", f"with {ROUTED} select id, route, reason, confidence from routed")
def exp16(t):
    return t("questions").select("id", _routed().alias("r")).select("id", "r.*")


@query("exp17_plans", rf"""with {ROUTED}, p as (select *, regexp_replace(coalesce(question, ''), '{BLANK}+', '', 'g') as sq from routed),
m as (select id, case when route = 'answer_audit' then 'audit' when route <> 'knowledge_search' then 'simple' when reason in ('contextual_followup', 'contextual_retry') and context_action <> 'switch' then 'contextual'
  when has_images or length(sq) >= 60 or regexp_matches(sq, '(?is){PATTERNS["complex"]}') or (has_context and (contains(sq, '继续') or contains(sq, '进一步') or contains(sq, '再分析') or contains(sq, '复盘'))) then 'complex' when sq <> '' and length(sq) <= 28 then 'simple_knowledge' else 'standard' end as complexity from p)
select id, case complexity when 'audit' then 'answer_audit' when 'simple' then 'direct' when 'contextual' then 'contextual_rag' when 'complex' then 'react_rag' else 'rag_once' end as strategy, complexity, case complexity when 'complex' then 16 when 'simple_knowledge' then 6 else -1 end as top_k, case complexity when 'complex' then 4 when 'simple_knowledge' then 1 else -1 end as top_docs from m""")
def exp17(t):
    rows = t("questions").withColumn("r", _routed())
    plan = ro.plan_retrieval(F.col("question"), F.col("r.route"), F.col("r.reason"), F.col("has_images"), F.col("has_context"), F.col("context_action"))
    return rows.select("id", plan.alias("p")).select("id", "p.*")
