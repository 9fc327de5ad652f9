# ruff: noqa: E501
"""Detection patterns, word lists and weights.

These values decide the results and are stated as they are. A pack given by the
user replaces or extends them (``tidewarden.sources.rules``).
"""

#: Personal data and secrets, in the order in which they are applied; case-sensitive.
PII = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("TOKEN", r"\b(?:sk|rk|pk)-[A-Za-z0-9\-_]{10,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CARD", r"\b(?:\d[ -]*?){13,16}\b"),
    ("CN_MOBILE", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("CN_ID", r"(?<!\d)\d{17}[\dXx](?!\d)"),
    ("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GITHUB_TOKEN", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("SLACK_TOKEN", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("IPV6", r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("URL_TOKEN_QUERY", r"https?://[^\s]+[?&](?:access_token|token|api[_-]?key|key|sig|signature|session(?:id)?|jwt|auth)=[A-Za-z0-9._%\-~+/=]{8,}"),
    ("COOKIE_SESSION", r"\b(?:session(?:id)?|sid|set-cookie|csrftoken|xsrf-token)\b\s*[:=]\s*[A-Za-z0-9._%\-]{8,}\b"),
    ("PRIVATE_KEY_PEM", r"-----BEGIN (?:RSA|EC|DSA|OPENSSH|PGP|PRIVATE) KEY-----"),
    ("AWS_SECRET_ACCESS_KEY", r"\baws[_-]?secret[_-]?access[_-]?key\b\s*[:=]\s*[A-Za-z0-9/+=]{40}\b"),
    ("BANK_ACCOUNT", r"\b(?:bank[_\s-]?account|acct(?:ount)?(?:[_\s-]?no)?|账户(?:号)?)\b\s*[:=]\s*[A-Za-z0-9\-]{8,24}\b"),
    ("SWIFT_BIC", r"\b(?:swift|bic)\b\s*[:=]\s*[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("ROUTING_NUMBER", r"\b(?:routing|aba)\b\s*[:=]\s*\d{9}\b"),
    ("PASSPORT_NO", r"\b(?:passport|护照)(?:[_\s-]?(?:no|number|号码))?\b\s*[:=]\s*[A-Z0-9]{6,12}\b"),
    ("DRIVER_LICENSE_NO", r"\b(?:driver(?:[_\s-]?license)?|驾照)(?:[_\s-]?(?:no|number|号码))?\b\s*[:=]\s*[A-Z0-9\-]{5,20}\b"),
    ("TAX_ID", r"\b(?:tax[_\s-]?(?:id|no|number)|ein|ssn|tin|税号)\b\s*[:=]\s*[A-Z0-9\-]{6,20}\b"),
    ("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("IMEI", r"\b(?:imei|设备imei)\b\s*[:=]\s*\d{15}\b"),
    ("IMSI", r"\b(?:imsi|subscriber[_\s-]?id)\b\s*[:=]\s*\d{14,16}\b"),
    ("DEVICE_SERIAL", r"\b(?:serial(?:[_\s-]?number)?|sn|设备序列号)\b\s*[:=]\s*[A-Za-z0-9\-]{6,40}\b"),
    ("CRYPTO_BTC_ADDR", r"\b(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}\b"),
    ("CRYPTO_ETH_ADDR", r"\b0x[a-fA-F0-9]{40}\b"),
    ("CRYPTO_SOL_ADDR", r"\b(?=[1-9A-HJ-NP-Za-km-z]*[G-HJ-NP-Zg-hj-km-z])[1-9A-HJ-NP-Za-km-z]{32,44}\b"),
    ("CRYPTO_TRON_ADDR", r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b"),
    ("CRYPTO_WIF_KEY", r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b"),
    ("CRYPTO_XPRV", r"\bxprv[1-9A-HJ-NP-Za-km-z]{60,120}\b"),
    ("CRYPTO_XPUB", r"\bxpub[1-9A-HJ-NP-Za-km-z]{60,120}\b"),
    ("CRYPTO_SEED_PHRASE", r"(?i)\b(?:seed(?:\s+phrase)?|mnemonic|助记词)\b\s*[:=]\s*(?:[a-z]{3,}\s+){11,23}[a-z]{3,}"),
    ("EXCHANGE_API_SECRET", r"(?i)\b(?:binance|okx|bybit|kucoin|gate|coinbase|bitget|kraken)[_\-\s]?(?:api[_\-\s]?(?:key|secret)|passphrase)\b\s*[:=]\s*[A-Za-z0-9._~+/=-]{8,}"),
    ("NAME_FIELD", r"(?i)\b(?:name|full[_\-\s]?name|real[_\-\s]?name|patient[_\-\s]?name|姓名|真实姓名)\b\s*[:=]\s*[^\n,;]{2,60}"),
    ("GEO_FIELD", r"(?i)\b(?:address|street|city|district|county|province|state|zip|zipcode|postal[_\-\s]?code|gps|lat(?:itude)?|lon(?:gitude)?|地址|省|市|区|县|街道|门牌|邮编)\b\s*[:=]\s*[^\n,;]{3,120}"),
    ("DATE_EXACT_FIELD", r"(?i)\b(?:dob|birth(?:date)?|admission(?:[_\-\s]?date)?|discharge(?:[_\-\s]?date)?|death(?:[_\-\s]?date)?|生日|出生日期|入院日期|出院日期|死亡日期)\b\s*[:=]\s*(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("FAX_FIELD", r"(?i)\b(?:fax|传真)\b\s*[:=]\s*(?:\+?\d[\d\-\s]{6,20})"),
    ("MEDICAL_RECORD_NO", r"(?i)\b(?:mrn|medical[_\-\s]?record(?:[_\-\s]?(?:id|no|number))?|病历(?:号|编号))\b\s*[:=]\s*[A-Za-z0-9\-]{4,30}"),
    ("HEALTH_PLAN_BENEFICIARY_NO", r"(?i)\b(?:member[_\-\s]?id|beneficiary[_\-\s]?(?:id|no|number)|health[_\-\s]?plan[_\-\s]?(?:id|no|number)|医保(?:号|编号))\b\s*[:=]\s*[A-Za-z0-9\-]{4,30}"),
    ("CERT_LICENSE_NO", r"(?i)\b(?:cert(?:ificate)?[_\-\s]?(?:id|no|number)|license[_\-\s]?(?:id|no|number)|执照(?:号|编号)|证书(?:号|编号))\b\s*[:=]\s*[A-Za-z0-9\-]{4,30}"),
    ("VEHICLE_VIN", r"(?i)\b(?:vin|vehicle[_\-\s]?id|车辆识别码)\b\s*[:=]\s*[A-HJ-NPR-Z0-9]{17}\b"),
    ("VEHICLE_PLATE", r"(?i)\b(?:plate|license[_\-\s]?plate|车牌)\b\s*[:=]\s*[A-Za-z0-9\u4e00-\u9fff\-]{5,12}"),
    ("BIOMETRIC_TEMPLATE", r"(?i)\b(?:fingerprint|faceprint|voiceprint|iris|retina|biometric|指纹|面纹|声纹|虹膜|生物特征)\b\s*[:=]\s*[A-Za-z0-9+/=._\-]{8,}"),
    ("SYS_HOSTNAME", r"(?i)\b(?:hostname|host[_\-\s]?name|主机名|计算机名)\b\s*[:=]\s*[A-Za-z0-9._\-]{2,60}"),
    ("SYS_USERNAME", r"(?i)\b(?:username|user[_\-\s]?name|login|whoami|用户名|登录名)\b\s*[:=]\s*[^\n,;]{2,40}"),
    ("SYS_OS_VERSION", r"(?i)\b(?:os[_\-\s]?(?:version|name|release)|operating[_\-\s]?system|系统版本|操作系统)\b\s*[:=]\s*[^\n,;]{3,80}"),
    ("SYS_KERNEL", r"(?i)\b(?:kernel|uname|内核版本)\b\s*[:=]\s*[^\n,;]{3,120}"),
    ("SYS_HOME_PATH", r"(?:(?:/home/|/Users/|C:\\Users\\|/root/)[A-Za-z0-9._\-]+(?:[/\\][A-Za-z0-9._\-]+){0,5})"),
    ("SYS_ENV_VAR", r"(?i)\b(?:env|environ|环境变量)\b\s*[:=]\s*[^\n]{3,200}"),
    ("SYS_DOCKER_ID", r"(?i)\b(?:container[_\-\s]?id|docker[_\-\s]?id|容器ID)\b\s*[:=]\s*[a-f0-9]{12,64}"),
    ("SYS_K8S_RESOURCE", r"(?i)\b(?:namespace|pod[_\-\s]?name|service[_\-\s]?name|命名空间|Pod名)\b\s*[:=]\s*[A-Za-z0-9._\-]{2,60}"),
    ("SYS_INTERNAL_URL", r"(?i)https?://[A-Za-z0-9._\-]+\.(?:internal|local|svc\.cluster\.local|corp|intranet)(?:[:/][^\s]*)?"),
]

#: Text that asks for secrets.
EXFILTRATION = [
    ("exfiltration_en", r"(reveal|show|dump|leak|print|secret|password|token|api\s*key|system\s+prompt)"),
    ("exfiltration_zh", r"(泄露|暴露|显示|输出|打印|给我|提供).*(密钥|口令|密码|令牌|token|api\s*key|系统提示词|系统提示)"),
]

#: Instructions inside untrusted content.
UNTRUSTED = [
    ("instructional_en", r"(ignore\s+.*instructions?|bypass\s+.*(policy|safety)|reveal\s+.*(system\s+prompt|developer\s+message)|run\s+command|execute\s+shell)"),
    ("instructional_zh", r"(忽略|无视).*(指令|规则|说明)|(绕过|关闭).*(安全|策略|限制)|(泄露|显示).*(系统提示词|开发者消息)"),
]

#: Direct prompt injection.
DIRECT = [
    ("ignore_previous_en", r"ignore\s+(all\s+)?(previous|prior)\s+instructions?"),
    ("override_safety_en", r"(bypass|override)\s+.{0,40}(safety|guardrails?|policy)"),
    ("developer_mode_en", r"(you\s+are\s+now|act\s+as)\s+.{0,40}(developer|root|admin)"),
    ("reveal_hidden_en", r"(reveal|show|print|dump|leak)\s+.{0,40}(system\s+prompt|developer\s+message|hidden\s+instructions?)"),
    ("repeat_prompt_en", r"(repeat|quote|verbatim)\s+.{0,40}(prompt|instructions?)"),
    ("ignore_previous_zh", r"(忽略|无视).{0,8}(之前|以上|先前).{0,8}(指令|说明|规则)"),
    ("override_safety_zh", r"(绕过|关闭).{0,4}(安全|防护|策略|限制)"),
    ("reveal_hidden_zh", r"(泄露|显示|输出|打印).{0,10}(系统提示词|开发者消息|隐藏指令)"),
    ("repeat_prompt_zh", r"(逐字|原样|完整).{0,8}(复述|输出).{0,8}(提示词|指令)"),
]

#: Requests for the system prompt.
SYSTEM_EXFIL = [
    ("system_prompt_request_en", r"(what|show|reveal)\s+.{0,40}system\s+prompt"),
    ("developer_message_request_en", r"(show|reveal|print)\s+.{0,40}developer\s+message"),
    ("delimiter_breakout_en", r"(ignore|forget)\s+.{0,40}(system|developer)\s+instructions"),
    ("system_prompt_request_zh", r"(显示|告诉|输出|泄露).{0,10}(系统提示词|系统提示)"),
    ("developer_message_request_zh", r"(显示|输出|泄露).{0,10}(开发者消息|开发提示)"),
]

#: Active markup.
HTML_MARKDOWN = [
    ("script_tag", r"<\s*script\b"),
    ("img_tag", r"<\s*img\b"),
    ("javascript_uri", r"javascript:\s*"),
    ("data_uri", r"data:\s*text/html"),
]

#: Links with instructions.
REMOTE_CONTENT = [
    ("markdown_link_instruction_en", r"\[[^\]]+\]\(https?://[^)]+\).{0,60}(follow|execute|instructions?)"),
    ("url_instruction_en", r"https?://\S+.{0,60}(follow|execute|instructions?)"),
    ("markdown_link_instruction_zh", r"\[[^\]]+\]\(https?://[^)]+\).{0,40}(按|执行|遵循).{0,20}(指令|说明)"),
    ("url_instruction_zh", r"https?://\S+.{0,40}(按|执行|遵循).{0,20}(指令|说明)"),
]

#: Injection by retrieved content.
INDIRECT = [
    ("retrieved_override_en", r"(retrieved|document|knowledge\s*base|web\s*page).{0,60}(ignore|override|bypass).{0,40}(instructions|policy|guardrails?)"),
    ("context_priority_hijack_en", r"(treat|use).{0,40}(this|retrieved|external).{0,30}(as|with).{0,30}(highest|top).{0,30}(priority|authority)"),
    ("retrieved_override_zh", r"(检索|文档|知识库|网页).{0,3}(忽略|覆盖|绕过).{0,4}(指令|规则|策略|安全)"),
    ("context_priority_hijack_zh", r"(将|把).{0,12}(检索内容|外部内容|文档).{0,8}(作为|设为).{0,8}(最高|最高级).{0,8}(优先级|权威)"),
]

#: Instructions from remote content.
REMOTE_INSTRUCTION = [
    ("copy_paste_terminal_en", r"(copy|paste).{0,40}(terminal|shell|powershell|cmd)|(run|execute).{0,30}(from|in).{0,30}(url|link|document)"),
    ("remote_tool_invocation_en", r"(follow|execute).{0,30}(tool|function|api).{0,30}(from|in).{0,30}(link|url|document)"),
    ("copy_paste_terminal_zh", r"(复制|粘贴).{0,10}(终端|shell|powershell|cmd)|(按|执行).{0,10}(链接|网页|文档).{0,10}(命令|脚本)"),
    ("remote_tool_invocation_zh", r"(根据|按照).{0,10}(链接|文档|网页).{0,10}(调用|执行).{0,10}(工具|函数|接口)"),
]

#: Forged tool calls.
TOOL_FORGERY = [
    ("multi_tool_use_parallel", r"to\s*=\s*mult[i_]*[_\s]*tool[_\s]*use[\._\s]*parall"),
    ("tool_uses_json", r"""[("']\s*tool_uses?\s*[)"']\s*[:=\[]"""),
    ("function_call_json", r"""[("']\s*function_calls?\s*[)"']\s*[:=\[]"""),
    ("fake_assistant_tool_block", r"""D\s*\(\s*["']\s*tool_uses?\s*["']"""),
    ("recipient_name", r"""recipient_name["']\s*:\s*["']functions?\."""),
    ("functions_namespace", r"functions?\.\s*(?:ls|exec|eval|run|read|write|delete|rm|cat|curl|wget|sh|bash|python|node|open|spawn|system)\b"),
    ("tool_call_prefix", r"tool_call\s*[:]\s*(?:functions?\.?\w+|\w+\.\w+)"),
    ("claude_tool_call_xml", r"<\s*tool_call\s*>"),
    ("claude_invoke_xml", r"<\s*invoke\s+name\s*="),
    ("claude_function_calls_xml", r"<\s*function_calls?\s*>"),
    ("react_action_input", r"Action\s*:\s*\w+[\s\S]{0,60}?Action\s+Input\s*:"),
    ("react_fake_observation", r"Observation\s*:\s*[\s\S]{0,80}?(?:Final\s+Answer|Action)\s*:"),
    ("gemini_function_call", r"""["']functionCall["']\s*:\s*\{"""),
    ("gemini_function_response", r"""["']functionResponse["']\s*:\s*\{"""),
    ("bedrock_tool_use", r"""["']toolUse["']\s*:\s*\{"""),
    ("bedrock_tool_result", r"""["']toolResult["']\s*:\s*\{"""),
    ("vllm_tool_call_tag", r"<\|?\s*tool_call\s*\|?>"),
    ("gorilla_function_tag", r"<<\s*function\s*>>"),
    ("autogpt_command", r"""["']command["']\s*:\s*\{\s*["']name["']"""),
    ("opendevin_action_run", r"""["']action["']\s*:\s*["']run["']"""),
    ("swe_agent_command", r"^\s*COMMAND\s*$"),
    ("mcp_tools_call", r"""["']method["']\s*:\s*["']tools/call["']"""),
    ("mcp_resources_read", r"""["']method["']\s*:\s*["']resources/read["']"""),
    ("tool_call_with_spam", r"(?:彩票|赛车|大发|快三|彩神|时时彩|一本道|毛片|无码|一级特黄|免费视频|天天中|争霸|官网群|福利彩|北京赛车|重庆时时).{0,60}(?:tool_use|function_call|tool_calls?|multi_tool|functions?\.)"),
    ("spam_with_tool_call", r"(?:tool_use|function_call|tool_calls?|multi_tool|functions?\.).{0,60}(?:彩票|赛车|大发|快三|彩神|时时彩|一本道|毛片|无码|一级特黄|免费视频|天天中|争霸|官网群|福利彩|北京赛车|重庆时时)"),
    ("to_eq_functions", r"to\s*=\s*functions?\.\s*\w+"),
]

#: Spam classes.
SPAM = [
    ("gambling_zh", r"(?:彩神争霸|大发快三|北京赛车|重庆时时彩|天天中彩票|天天爱彩票|腾讯分分彩|大发时时彩|大发彩票|六合彩|大发快|香港赛马会|福利彩票天天|天天乐彩票|全民彩票|彩票平台注册|彩票平台开户|彩票娱乐注册)"),
    ("porn_zh", r"(?:毛片|无码|一级特黄|一本道|久久精品|久久综合|男人天堂|做爰片|黄色录像|高清无码|免费视频观看|AV不卡免费|夫妻性生活|中文字幕无码)"),
    ("spam_platform", r"(?:菲律宾申博|娱乐平台注册|娱乐平台招商|娱乐平台开户|棋牌游戏官网|娱乐官方网站|娱乐彩票注册|娱乐平台主管)"),
]

#: Discussion context of injection findings.
DISCUSSION_INJECTION = [
    ("p0", r"(用于|用于研究|安全研究|教学|示例|样例|引用|分析|解释|检测|防护|OWASP|论文|学习路线|面试题|转型建议|开发指南|最佳实践|教程|原理|架构设计|做法是|投毒|后门|常见方式|常见效果|风险等级|危险点|典型后果|攻击类型|威胁模型|防御措施)"),
    ("p1", r"(for\s+research|for\s+analysis|for\s+education|for\s+teaching|for\s+example|quoted|citation|security\s+testing|owasp|case\s+study|best\s+practice|tutorial|interview|learning\s+path|architecture|poisoning|backdoor|threat\s+model|attack\s+type|common\s+effect)"),
]

#: Quoted instructions.
QUOTED = [
    ("p0", r"""["'`\u201c\u201d\u300c\u300d\u300e\u300f].{0,120}(ignore|bypass|override|忽略|绕过).{0,120}["'`\u201c\u201d\u300c\u300d\u300e\u300f]"""),
    ("p1", r"```[\s\S]{0,200}?(ignore|bypass|override|忽略|绕过)[\s\S]{0,200}?```"),
]

#: Poison in documents to be indexed.
RAG_INGESTION = [
    ("ingestion_override_en", r"(ignore|override|bypass).*(instructions|policy|guardrails?)"),
    ("ingestion_exfil_en", r"(reveal|dump|print|show).*(system\s+prompt|developer\s+message|api\s*key|token|password)"),
    ("ingestion_override_zh", r"(忽略|覆盖|绕过).*(指令|规则|策略|安全)"),
    ("ingestion_exfil_zh", r"(泄露|显示|输出|打印).*(系统提示词|开发者消息|密钥|令牌|token|密码)"),
    ("hidden_markup_payload", r"(<!--[\s\S]{0,300}?(ignore|override|bypass)|BEGIN[_\s-]?PROMPT[_\s-]?INJECTION|data:\s*text/html|javascript:)"),
]

#: Poison in retrieved content.
RAG_RETRIEVAL = [
    ("retrieval_instruction_en", r"(retrieved|document|web|link).*(follow|execute|run|copy|paste).*(instruction|command|script|shell)"),
    ("retrieval_tool_en", r"(call|invoke|use).*(tool|function|api).*(from|according to).*(retrieved|document|web|link)"),
    ("retrieval_instruction_zh", r"(检索|文档|网页|链接).*(按|执行|运行|复制|粘贴).*(指令|命令|脚本|shell)"),
    ("retrieval_tool_zh", r"(调用|使用|执行).*(工具|函数|接口).*(根据|按照).*(检索|文档|网页|链接)"),
]

#: Poison passed on in output.
RAG_PROPAGATION = [
    ("propagation_cmd_en", r"(run|execute|copy|paste).*(shell|powershell|cmd|bash)|curl\s+[^|]+\|\s*(sh|bash)"),
    ("propagation_exfil_en", r"(reveal|dump|print|show).*(system\s+prompt|developer\s+message|api\s*key|token|password)"),
    ("propagation_cmd_zh", r"(执行|运行|复制|粘贴).*(命令|脚本|终端|shell)"),
    ("propagation_exfil_zh", r"(泄露|显示|输出|打印).*(系统提示词|开发者消息|密钥|令牌|token|密码)"),
]

#: Discussion context of privilege findings.
DISCUSSION_PRIVILEGE = [
    ("p0", r"(用于|用于研究|安全研究|教学|示例|样例|引用|分析|解释|检测|防护|OWASP|论文|案例|复盘)"),
    ("p1", r"(for\s+research|for\s+analysis|for\s+education|for\s+teaching|for\s+example|quoted|citation|security\s+testing|owasp|case\s+study|postmortem|writeup|best\s+practice)"),
]

#: Privilege abuse.
PRIVILEGE = [
    ("read_etc_passwd_en", r"(cat|type|more)\s+/etc/passwd"),
    ("read_ssh_en", r"(read|cat|show)\s+~/.ssh"),
    ("dump_secret_en", r"(dump|reveal|leak|exfiltrate).*(secret|password|api\s*key|private\s*key|credentials?)"),
    ("execute_shell_en", r"(run|execute)\s+(a\s+)?(shell|bash|powershell|cmd)\s+(command|script)"),
    ("read_local_zh", r"(读取|导出).*(系统文件|\/etc\/|\/proc\/|\.ssh)"),
    ("leak_secret_zh", r"(泄露|导出).*(密钥|口令|密码|私钥|凭据)"),
    ("run_cmd_zh", r"(执行|运行).*(shell|powershell|cmd|bash)\s*(命令|脚本)"),
]

#: Attack commands in text.
COMMANDS = [
    ("sqli_union_select", r"\bunion\s+select\b"),
    ("sqli_time_blind", r"\b(?:sleep|benchmark|pg_sleep)\s*\(\s*\d+\s*\)"),
    ("command_injection_chain", r"(?:;|\|\||&&|\|)\s*(?:curl|wget|bash|sh|nc|ncat|powershell|cmd(?:\.exe)?)\b"),
    ("command_injection_scripting", r"(?:;|\|\||&&|\|)\s*(?:python[23]?|perl|ruby|php)\s+-[ce]\b"),
    ("xxe_external_entity", r"(?:<!DOCTYPE[^>]*\[[\s\S]{0,200}?<!ENTITY|<!ENTITY\s+%?\w+\s+SYSTEM\s+(?:file|https?)://)"),
    ("ssti_or_log4shell", r"(?:\{\{\s*7\s*\*\s*7\s*\}\}|\$\{jndi:(?:ldap|rmi|dns|iiop)://)"),
    ("ssrf_metadata", r"(?:https?://)?(?:169\.254\.169\.254|169\.254\.170\.2|metadata\.google\.internal)(?::\d+)?(?:/|\b)"),
    ("crlf_header_injection", r"(?:%0d%0a|\r\n)\s*(?:set-cookie:|location:|x-forwarded-)"),
]

#: Attacks on HTTP framing.
HTTP_FRAMING = [
    ("web_http_smuggling_cl_te", r"(?is)\bcontent-length\s*:\s*\d+\s*(?:\\r\\n|\r\n|\n)+\s*transfer-encoding\s*:\s*chunked\b"),
    ("web_http_smuggling_te_cl", r"(?is)\btransfer-encoding\s*:\s*chunked\b\s*(?:\\r\\n|\r\n|\n)+\s*content-length\s*:\s*\d+"),
    ("web_http_smuggling_te_te", r"(?is)\btransfer-encoding\s*:\s*(?:[^\r\n,]+,\s*)+chunked\b"),
    ("web_http_response_splitting", r"(?is)(?:%0d%0a|\\r\\n|\r\n)\s*http/1\.[01]\s+\d{3}\b"),
    ("web_http_obs_fold_header", r"(?is)(?:%0d%0a|\\r\\n|\r\n)[ \t]+(?:content-length|transfer-encoding|host|x-forwarded-[a-z-]+)\s*:"),
]

#: Discussion context of requests and outputs.
DISCUSSION_REQUEST = [
    ("p0", r"(用于|用于研究|安全研究|教学|示例|样例|引用|分析|解释|检测|防护|OWASP|论文)"),
    ("p1", r"(for\s+research|for\s+analysis|for\s+education|for\s+teaching|for\s+example|quoted|citation|security\s+testing|owasp|case\s+study)"),
]

#: Category of each strong intent.
INTENT_CATEGORY = {"secret_exfiltration_en": "secret_exfiltration", "secret_exfiltration_zh": "secret_exfiltration", "privilege_escalation_en": "privilege_escalation", "privilege_escalation_zh": "privilege_escalation", "rule_bypass_en": "rule_bypass", "rule_bypass_zh": "rule_bypass"}

#: Strong intents.
STRONG_INTENT = [
    ("secret_exfiltration_en", r"(reveal|show|dump|print|leak|output|export).*(system\s+prompt|developer\s+message|api\s*key|token|cookie|password|private\s*key|ssh\s*key|seed\s*phrase|mnemonic|wallet\s*key|xprv|exchange\s*secret)"),
    ("secret_exfiltration_zh", r"(泄露|显示|输出|打印|给我|提供|导出).*(系统提示词|开发者消息|密钥|口令|密码|令牌|token|cookie|私钥|ssh\s*key|助记词|种子短语|钱包密钥|交易所密钥)"),
    ("privilege_escalation_en", r"(read|open|cat|dump|export).*(local\s+file|system\s+file|\/etc\/|\/proc\/|\.ssh)|((execute|run)\s+(a\s+)?(shell|powershell|cmd|bash)\s+(command|script))|(access|scan).*(intranet|internal\s+network|internal\s+server|production\s+database)"),
    ("privilege_escalation_zh", r"(读取|打开|导出).*(本地文件|系统文件|系统配置|服务器日志|生产数据库)|(执行|运行).*(shell|powershell|cmd|bash)\s*(命令|脚本)|(访问|探测).*(内网|内部网络|生产服务器|生产数据库)"),
    ("rule_bypass_en", r"(ignore|override|bypass).*(previous\s+instructions?|safety|policy)|from\s+now\s+on.*(you\s+are|act\s+as).*(system|developer|admin)"),
    ("rule_bypass_zh", r"(忽略|无视|绕过).*(之前|先前).*(指令|规则|安全策略)|从现在起.*(你是|你扮演).*(system|developer|admin|管理员)"),
]

#: Secrets in requests.
LEAK = [
    ("api_key_generic", r"\b(?:api[_-]?key|token|cookie|password)\s*[:=]\s*[A-Za-z0-9._\-]{8,}\b"),
    ("openai_like", r"\b(?:sk|rk|pk)-[A-Za-z0-9\-_]{10,}\b"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("private_key_block", r"-----BEGIN (?:RSA|EC|OPENSSH|PRIVATE) KEY-----"),
    ("cookie_header", r"\bcookie\s*:\s*[^;\n]{8,}"),
    ("jwt_token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("aws_secret_access_key", r"\baws[_-]?secret[_-]?access[_-]?key\b\s*[:=]\s*[A-Za-z0-9/+=]{40}\b"),
    ("crypto_private_key_wif", r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b"),
    ("crypto_xprv", r"\bxprv[1-9A-HJ-NP-Za-km-z]{60,120}\b"),
    ("crypto_seed_phrase", r"(?i)\b(?:seed(?:\s+phrase)?|mnemonic|助记词)\b\s*[:=]\s*(?:[a-z]{3,}\s+){11,23}[a-z]{3,}"),
    ("exchange_secret", r"(?i)\b(?:binance|okx|bybit|kucoin|gate|coinbase|bitget|kraken)[_\-\s]?(?:api[_\-\s]?(?:key|secret)|passphrase)\b\s*[:=]\s*[A-Za-z0-9._~+/=-]{8,}"),
    ("url_token_query", r"https?://[^\s]+[?&](?:access_token|token|api[_-]?key|key|sig|signature|session(?:id)?|jwt|auth)=[A-Za-z0-9._%\-~+/=]{8,}"),
]

#: Anomalous shapes.
SHAPE = [
    ("dense_base64", r"[A-Za-z0-9+/]{200,}={0,2}"),
    ("dense_hex", r"\b[0-9a-fA-F]{300,}\b"),
    ("dense_url_encoded", r"(%[0-9A-Fa-f]{2}){12,}"),
    ("prompt_flood", r"(?i)(ignore previous instructions){3,}"),
]

#: Web attack commands.
WEB_COMMANDS = [
    ("web_sqli", r"(\bunion\s+select\b|\b(?:or|and)\s+1\s*=\s*1\b|\b(?:sleep|benchmark|pg_sleep)\s*\(\s*\d+\s*\))"),
    ("web_xss", r"(?:<\s*script\b|on(?:error|load|mouseover)\s*=|javascript:\s*)"),
    ("web_path_traversal", r"(?:\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|%252e%252e%252f|/etc/passwd\b|/proc/self/environ\b|win\.ini\b)"),
    ("web_command_injection", r"(?:;|\|\||&&|\|)\s*(?:curl|wget|bash|sh|nc|ncat|powershell|cmd(?:\.exe)?)\b"),
    ("web_command_injection_scripting", r"(?:;|\|\||&&|\|)\s*(?:python[23]?|perl|ruby|php)\s+-[ce]\b"),
    ("web_xxe_ssti", r"(?:<!DOCTYPE[^>]*\[[\s\S]{0,200}?<!ENTITY|<!ENTITY\s+%?\w+\s+SYSTEM\s+(?:file|https?)://|\{\{\s*7\s*\*\s*7\s*\}\}|\$\{jndi:(?:ldap|rmi|dns|iiop)://)"),
    ("web_ssrf_crlf", r"((?:https?://)?(?:169\.254\.169\.254|169\.254\.170\.2|metadata\.google\.internal)(?::\d+)?(?:/|\b)|(?:%0d%0a|\r\n)\s*(?:set-cookie:|location:|x-forwarded-))"),
]

#: Encoded payloads.
ENCODED = [
    ("base64_long", r"[A-Za-z0-9+/]{200,}={0,2}"),
    ("hex_long", r"\b[0-9a-fA-F]{300,}\b"),
    ("url_encoded_dense", r"(%[0-9A-Fa-f]{2}){12,}"),
]

#: Output that discloses the system prompt.
SYSTEM_LEAK = [
    ("system_leak_disclosure_en", r"(?:my\s+(?:system\s+)?(?:prompt|instructions?)\s+(?:say|says|read|state|include|tell\s+me)\s*[:：]|(?:here\s+is|following\s+is|below\s+is)\s+my\s+(?:system\s+)?(?:prompt|instructions?)\s*[:：]|i\s+(?:was|am|have\s+been)\s+(?:told|instructed|configured|programmed)\s+(?:not\s+)?to\s+(?:reveal|share|disclose|discuss|mention)\s)"),
    ("system_leak_disclosure_zh", r"(?:(?:这里是|以下是|如下是|我的)系统提示词\s*[：:]|我的(?:指令|提示词)\s*(?:是|说|要求|内容)\s*[：:]|我被(?:告知|指示|设置|配置)(?:不要|不能|要|必须)(?:透露|分享|泄露|说|提及))"),
]

#: Unsafe markup.
MARKUP = [
    ("script", r"<\s*(script|iframe)\b"),
]

#: Unsafe addresses.
URI = [
    ("unsafe_uri", r"(javascript:|data:text/html)"),
]

#: Shapes of tool parameters (tool.parameter), matched from the start.
PARAMETER_SHAPES = [
    ("search.q", r"^.{1,500}$"),
    ("weather.location", r"^.{1,120}$"),
]

#: Dangerous tool parameters; case-sensitive.
DANGEROUS_PARAMETERS = [
    ("shell_injection", r"(?:;|\|\||&&|\|)\s*(?:curl|wget|bash|sh|nc|ncat|powershell|cmd(?:\.exe)?)\b"),
    ("shell_injection_scripting", r"(?:;|\|\||&&|\|)\s*(?:python[23]?|perl|ruby|php)\s+-[ce]\b"),
    ("shell_dangerous_cmd", r"(?:rm\s+-[a-zA-Z]*r[a-zA-Z]*f|rm\s+-[a-zA-Z]*f[a-zA-Z]*r|mkfs\b|dd\s+if=.*of=|chmod\s+-R\s+777\s+/|>\s*/dev/sd[a-z])"),
    ("shell_subshell_exec", r"\$\(\s*(?:curl|wget|bash|sh|nc|python[23]?|perl|ruby|php)\b"),
    ("backtick_exec", r"`\s*(?:curl|wget|bash|sh|nc|python[23]?|perl|ruby|php)\b"),
    ("sensitive_file_access", r"(/etc/(?:passwd|shadow|sudoers)|/var/run/secrets|/proc/self/environ)"),
    ("path_traversal", r"(\.\.\/)(?:.*\/)?(?:etc|proc|var|root|home)\/"),
    ("ssh_key_access", r"~/.ssh/(?:id_|authorized_keys|known_hosts|config)"),
    ("zh_sensitive", r"(提权|读取本地密钥|导出.*(?:密钥|口令|凭据))"),
]

#: Tool calls that need approval.
SEMANTIC_APPROVAL = [
    ("approval_en", r"\b(exfiltrate|leak\s+(?:secret|key|token|credential))\b"),
    ("destructive_en", r"\b(drop\s+(?:table|database|collection)|shutdown\s+(?:server|service|system))\b"),
    ("approval_zh", r"(泄露.*(?:密钥|口令|凭据)|清空.*(?:数据库|表|集合))"),
]

#: Lures to pass on restored secrets.
LURES = [
    ("copy_paste_en", r"(copy|paste|send|share|post).*(token|key|secret|credential|config)"),
    ("copy_paste_zh", r"(复制|粘贴|发送|分享|贴到).*(token|密钥|口令|凭据|配置)"),
]

#: Of LEAK, what counts as a restored secret.
RESTORED_SECRETS = ["openai_like", "aws_access_key", "github_token", "private_key_block", "jwt_token", "aws_secret_access_key", "crypto_private_key_wif", "crypto_xprv", "crypto_seed_phrase", "exchange_secret"]

#: Bucket and severity (of 10) of each injection signal.
SIGNALS = {
    "direct": ("intent", 5),
    "system_exfil": ("intent", 10),
    "obfuscated": ("payload", 9),
    "html_markdown": ("payload", 3),
    "remote_content": ("hijack", 5),
    "remote_content_instruction": ("hijack", 6),
    "indirect_injection": ("hijack", 6),
    "typoglycemia": ("hijack", 4),
    "unicode_invisible": ("anomaly", 4),
    "tool_call_injection": ("hijack", 6),
    "spam_noise": ("hijack", 7),
    "unicode_bidi": ("anomaly", 10),
}

#: Points and bucket of each anomaly.
POINTS = {
    "repetition_ratio": ("anomaly", 0.25),
    "max_run_length": ("anomaly", 0.2),
    "repeated_line": ("anomaly", 0.2),
    "base64_payload": ("payload", 0.35),
    "hex_payload": ("payload", 0.3),
    "url_encoded_payload": ("payload", 0.2),
    "invisible_chars": ("anomaly", 0.25),
    "bidi_control": ("anomaly", 0.4),
    "high_risk_command": ("payload", 0.4),
}

#: Action by stage and category.
ACTIONS = {
    ("injection_detector", "system_exfil"): "block",
    ("injection_detector", "obfuscated"): "block",
    ("injection_detector", "unicode_bidi"): "block",
    ("injection_detector", "unicode_invisible"): "review",
    ("injection_detector", "remote_content"): "review",
    ("injection_detector", "remote_content_instruction"): "review",
    ("injection_detector", "indirect_injection"): "review",
    ("injection_detector", "direct"): "downgrade",
    ("injection_detector", "typoglycemia"): "review",
    ("injection_detector", "tool_call_injection"): "review",
    ("injection_detector", "spam_noise"): "block",
    ("rag_poison_guard", "ingestion_poison"): "block",
    ("rag_poison_guard", "retrieval_poison"): "review",
    ("rag_poison_guard", "poison_propagation"): "block",
    ("untrusted_content_guard", "suspicious_untrusted"): "review",
    ("restoration", "exfiltration"): "block",
    ("restoration", "too_many_placeholders"): "block",
    ("restoration", "stale_mapping"): "block",
    ("restoration", "partial_restore"): "review",
    ("tool_call_guard", "disallowed_tool"): "review",
    ("tool_call_guard", "dangerous_param"): "block",
    ("tool_call_guard", "invalid_param"): "review",
    ("tool_call_guard", "semantic_review"): "review",
    ("sanitizer", "system_leak"): "block",
    ("request_sanitizer", "secret_exfiltration"): "review",
    ("request_sanitizer", "privilege_escalation"): "review",
    ("request_sanitizer", "rule_bypass"): "review",
    ("request_sanitizer", "leak_check"): "review",
    ("request_sanitizer", "shape_anomaly"): "sanitize",
    ("post_restore_guard", "restored_secret_lure"): "sanitize",
}

#: Trust and risk multiplier of sources.
SOURCE_TRUST = {
    "system": (True, 0.2),
    "user": (True, 0.5),
    "retrieval": (False, 1.0),
    "web": (False, 1.1),
    "tool": (False, 1.1),
    "external": (False, 1.2),
    "partner_feed": (False, 1.2),
}

TYPO_TARGETS = ["ignore", "bypass", "override", "reveal", "system", "prompt", "instructions"]

DECODED_KEYWORDS = ["ignore previous instructions", "reveal system prompt", "developer message", "bypass safety", "override policy", "忽略之前所有指令", "忽略以上所有指令", "泄露系统提示词", "显示开发者消息"]

OBFUSCATED = ["ignoreallpreviousinstructions", "忽略之前所有指令", "忽略以上所有指令"]

#: Look-alike code points and the letters they stand for.
CONFUSABLES = {0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0456: "i", 0x0455: "s", 0x03BF: "o", 0x03C1: "p", 0x03BD: "v", 0xFF4D: "m"}
INVISIBLE = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD]
BIDI = [0x202A, 0x202B, 0x202D, 0x202E, 0x202C, 0x2066, 0x2067, 0x2068, 0x2069]
UNTRUSTED_SOURCES = ["external", "retrieval", "web", "tool", "plugin", "document"]

#: Networks that aren't globally routable, or are reserved, by the registries of special-purpose addresses (fixed values).
BLOCKED_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6",
    "fc00::/7", "fe00::/9", "fe80::/10", "2001::/23", "2001:db8::/32", "2002::/16",
]
#: Networks inside those that are global (fixed values); the mapped ones are IPv4.
GLOBAL_NETWORKS = ["::ffff:0:0/96", "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

# ---- fixed values: fields of JSON bodies --------------------------------------

#: Fields that are no content.
IDENTITY_FIELDS = ["id", "call_id", "tool_call_id", "type", "role", "name", "status"]
#: Fields of encrypted values, and ends of such names.
CIPHER_FIELDS = ["encrypted_content", "encrypted_payload", "encrypted_text", "ciphertext", "cipher", "iv", "nonce", "tag", "auth_tag", "mac", "hmac", "signature", "sig", "ephemeral_key", "ephemeral_public_key"]
CIPHER_ENDS = ["_ciphertext", "_encrypted", "_encrypted_content", "_auth_tag", "_nonce", "_iv", "_mac", "_signature"]
#: Fields that locate media, fields that do so in some places, and the blocks whose source is media.
MEDIA_FIELDS = ["image_url", "file_id"]
MEDIA_URL_FIELDS = ["url", "uri"]
MEDIA_BLOCKS = ["image", "input_image", "document", "input_document", "audio", "input_audio", "video", "input_video", "file", "input_file"]

#: Shapes of script attacks that are sure; pages hold plain script tags.
SURE_SCRIPTS = [
    r"(?:%3c|\\x3c)\s*/?\s*script\b",
    r"</\s*script\s*>\s*<\s*script\b",
    r"javascript\s*:\s*(?:alert|prompt|confirm)\s*\(",
    r"on(?:error|load|mouseover)\s*=\s*['\"]?\s*(?:alert|prompt|confirm|document\.cookie)",
]
#: Parts of the ids of rules that need a sure shape, and how many rules a response is cleaned by at most.
SCRIPT_HINTS = ["xss", "script_event"]
MOST_RESPONSE_RULES = 24
