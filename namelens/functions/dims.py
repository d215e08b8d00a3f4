"""The dictionaries that name analysis looks words up in.

Small tables are stated below. Larger ones are built: pinyin syllables and their
Cyrillic forms from the initials and finals of Mandarin, and the surname
dictionary from (hanzi, reading) pairs that are a parameter (`Dictionary`), with
common surnames as the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

# --- fixed values: numbers of each source --------------------------------------

SOURCE_FIELDS = (
    "chinese_prior_fam", "chinese_prior_giv", "western_prior_fam", "western_prior_giv", "mixed_prior_fam", "mixed_prior_giv",
    "threshold_cn", "threshold_west", "threshold_mixed",
    "person_conf", "person_override", "person_override_conf", "pub_conf", "pub_override", "pub_override_conf", "pub_min_diff",
)
SOURCE_CONFIGS = {
    "CROSSREF": (0.3, 0.1, 0.1, 0.5, 0.2, 0.3, 0.4, 0.2, 0.3, 0.7, 0.6, 0.75, 0.7, 0.5, 0.65, 2),
    "ORCID": (0.3, 0.1, 0.1, 0.5, 0.2, 0.3, 0.4, 0.2, 0.3, 0.6, 0.5, 0.8, 0.7, 0.5, 0.65, 2),
    "ISTINA": (0.5, 0.1, 0.2, 0.3, 0.3, 0.2, 0.5, 0.3, 0.4, 0.65, 0.55, 0.7, 0.65, 0.5, 0.6, 2),
    "DEFAULT": (0.3, 0.2, 0.2, 0.4, 0.25, 0.25, 0.4, 0.3, 0.4, 0.7, 0.6, 0.7, 0.7, 0.5, 0.65, 2),
}
SOURCE_SPELLINGS = {
    "CROSSREF": "CROSSREF", "crossref": "CROSSREF", "Crossref": "CROSSREF", "ORCID": "ORCID", "orcid": "ORCID", "Orcid": "ORCID",
    "ISTINA": "ISTINA", "istina": "ISTINA", "Istina": "ISTINA", "ИСТИНА": "ISTINA",
}
#: Spellings that the score rules accept, which are fewer than the configurations'.
INTERNATIONAL = ("CROSSREF", "ORCID", "crossref", "orcid")
ISTINA = ("ISTINA", "istina", "ИСТИНА")

# --- fixed values: frequency rank of surname readings (the last of equal readings counts) ---

FREQUENCY_RANK = {
    "zhang": 3, "liu": 4, "chen": 5, "yang": 6, "huang": 7, "zhao": 8, "zhou": 10, "sun": 12, "ma": 13, "zhu": 14, "hu": 15, "guo": 16,
    "gao": 18, "lin": 19, "luo": 20, "zheng": 21, "liang": 22, "xie": 23, "song": 24, "tang": 25, "xu": 26, "deng": 27, "han": 28,
    "feng": 29, "cao": 30, "peng": 31, "zeng": 32, "xiao": 33, "tian": 34, "dong": 35, "pan": 36, "yuan": 37, "cai": 38, "yu": 40, "du": 41,
    "ye": 42, "cheng": 43, "su": 45, "ding": 47, "ren": 48, "shen": 49, "yao": 50, "lu": 51, "cui": 53, "tan": 54, "liao": 55, "fan": 56,
    "wang": 57, "jin": 59, "wei": 60, "jia": 61, "xia": 62, "fang": 64, "zou": 65, "xiong": 66, "bai": 67, "meng": 68, "qin": 69, "qiu": 70,
    "hou": 71, "jiang": 72, "yin": 73, "xue": 74, "duan": 76, "lei": 77, "long": 78, "li": 79, "shi": 80, "tao": 81, "he": 82, "gu": 83,
    "mao": 84, "hao": 85, "gong": 86, "shao": 87, "wan": 88, "qian": 89, "yan": 90, "fu": 91, "wu": 92, "dai": 93, "mo": 94, "kong": 95,
    "xiang": 96, "chang": 97,
}
NO_RANK = 999

# --- fixed values: romanisation variants of readings ---------------------------

VARIANTS = {
    "chan": ["chen"], "wong": ["wang", "huang"], "ho": ["he"], "chow": ["zhou"], "cheung": ["zhang"], "chung": ["zhong"],
    "leung": ["liang"], "lau": ["liu"], "ng": ["wu", "ng"], "yip": ["ye"], "mak": ["mo"], "szeto": ["situ"], "yeung": ["yang"],
    "tam": ["tan"], "cheng": ["zheng"], "tse": ["xie"], "siu": ["xiao"], "ko": ["ge"], "kwan": ["guan"], "hsu": ["xu"], "tsai": ["cai"],
    "teng": ["deng"], "chu": ["zhu"], "ch'en": ["chen"], "chang": ["zhang"], "chao": ["zhao"], "chou": ["zhou"], "ch'ien": ["qian"],
    "ch'in": ["qin"], "ch'eng": ["cheng"], "ch'ang": ["chang"], "ts'ao": ["cao"], "ts'ui": ["cui"], "tung": ["dong"], "tang": ["dang"],
    "soong": ["song"], "kung": ["kong"], "kuo": ["guo"], "lo": ["luo"], "chiu": ["qiu"], "lyu": ["lv"],
}

# --- fixed values: traditional spellings with hanzi and reading; later systems override ---

TRADITIONAL = {
    "lee": ("李", "li"), "chang": ("张", "zhang"), "wang": ("王", "wang"), "chen": ("陈", "chen"), "lin": ("林", "lin"), "huang": ("黄", "huang"),
    "wu": ("吴", "wu"), "cheng": ("郑", "zheng"), "liu": ("刘", "liu"), "yang": ("杨", "yang"), "hsu": ("徐", "xu"), "hsieh": ("谢", "xie"),
    "chu": ("朱", "zhu"), "chao": ("赵", "zhao"), "sun": ("孙", "sun"), "ma": ("马", "ma"), "kao": ("高", "gao"), "chou": ("周", "zhou"),
    "chiang": ("蒋", "jiang"), "shen": ("沈", "shen"), "tsai": ("蔡", "cai"), "tseng": ("曾", "zeng"), "han": ("韩", "han"),
    "tang": ("唐", "tang"), "feng": ("冯", "feng"), "yu": ("于", "yu"), "tung": ("董", "dong"), "hsiao": ("萧", "xiao"), "chung": ("钟", "zhong"),
    "pan": ("潘", "pan"), "liang": ("梁", "liang"), "tien": ("田", "tian"), "fan": ("范", "fan"), "yen": ("严", "yan"), "lu": ("陆", "lu"),
    "shih": ("施", "shi"), "mao": ("毛", "mao"), "hao": ("郝", "hao"), "tai": ("戴", "dai"), "wan": ("温", "wen"), "wong": ("王/黄", "wang/huang"),
    "chan": ("陈", "chen"), "lam": ("林", "lin"), "ng": ("黄", "huang"), "cheung": ("张", "zhang"), "leung": ("梁", "liang"),
    "choi": ("蔡", "cai"), "tsang": ("曾", "zeng"), "yip": ("叶", "ye"), "lau": ("刘", "liu"), "mak": ("麦", "mai"), "tse": ("谢", "xie"),
    "yeung": ("杨", "yang"), "tam": ("谭", "tan"), "poon": ("潘", "pan"), "fong": ("方", "fang"), "ho": ("何", "he"), "au": ("区", "ou"),
    "ko": ("高", "gao"), "lok": ("骆", "luo"), "siu": ("萧", "xiao"), "tong": ("唐", "tang"), "lim": ("林", "lin"), "tan": ("陈", "chen"),
    "ong": ("王", "wang"), "teo": ("张", "zhang"), "goh": ("吴", "wu"), "koh": ("许", "xu"), "tay": ("郑", "zheng"), "ang": ("洪", "hong"),
    "foo": ("傅", "fu"), "kwa": ("柯", "ke"), "sim": ("沈", "shen"), "toh": ("卓", "zhuo"), "liou": ("刘", "liu"), "liew": ("刘", "liu"),
    "shieh": ("谢", "xie"), "hwang": ("黄", "huang"), "soong": ("宋", "song"), "lai": ("赖", "lai"), "yee": ("余", "yu"), "yuen": ("袁", "yuan"),
}

# --- fixed values: western name features ---------------------------------------

WESTERN_SUFFIXES = (
    "son sen man mann berg burg stein stain feld field wood ward land ov ova ev eva sky ski ska cki vich vitch vic enko uk "
    "inen nen ard chard eau ault ier iere ini ino elli ello otti otto ez es os as is ian yan"
).split()
WESTERN_CLUSTERS = "sch tsch ck cz dz th gh ph gn kh shch str spr".split()
LATIN_EXTENDED = "äöüñçåøæœéèêëïîàâ"
WESTERN_SURNAMES = (
    "smith johnson williams brown jones miller davis garcia rodriguez wilson martinez anderson taylor thomas hernandez moore martin "
    "jackson thompson white lopez lee gonzalez harris clark lewis robinson walker perez hall young allen sanchez wright king scott "
    "green baker adams nelson hill ramirez campbell mitchell roberts carter phillips evans turner torres parker collins edwards "
    "stewart flores morris nguyen murphy rivera cook rogers mueller muller schmidt schneider fischer weber meyer wagner becker schulz "
    "hoffmann koch richter klein wolf schroeder neumann schwartz bernard dubois robert richard petit durand leroy moreau simon laurent "
    "lefebvre michel david bertrand roux vincent fournier morel rossi russo ferrari esposito bianchi romano colombo ricci marino greco "
    "bruno gallo conti fernandez gomez ruiz jimenez diaz ivanov smirnov kuznetsov popov vasiliev petrov sokolov mikhailov fedorov "
    "morozov volkov alekseev lebedev kowalski wisniewski dabrowski lewandowski wojcik kaminski kowalczyk zielinski szymanski wozniak "
    "korhonen virtanen makinen nieminen makela hamalainen laine heikkinen koskinen jarvinen jong jansen vries berg dijk bakker janssen "
    "visser smit meijer boer mulder groot bos vos peters savolainen desrichard friedemann aberson lukyanenko rutherford verhoeven "
    "santtila mignard adjodah tonello congedo cillo vatakis marttila"
).split() + ["de luca"]
FOREIGN_GIVEN = (
    "john james robert michael william david richard joseph thomas charles daniel matthew mark donald paul steven andrew joshua kenneth "
    "kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon "
    "benjamin samuel frank gregory raymond alexander patrick jack dennis jerry tyler aaron adam henry nathan douglas zachary peter kyle "
    "walter harold jeremy ethan christopher anthony vladimir sergey sergei dmitry dmitri andrey alexey ivan mikhail nikolay evgeny maxim "
    "igor oleg pavel roman victor anatoly boris valery yuri mohammad mohammed muhammad ahmed hassan hussein omar abdel abdul ibrahim "
    "khalid mahmoud said jean pierre jacques francois antonio jose manuel carlos luis miguel pedro juan jorge fernando ricardo roberto "
    "francisco eduardo alberto rafael"
).split()

# --- fixed values: keywords of affiliations --------------------------------------

CHINESE_KEYWORDS = [
    "china", "p.r. china", "p. r. china", "peoples republic of china", "people's republic of china", "中国", "中华人民共和国",
    "beijing", "shanghai", "guangzhou", "shenzhen", "hangzhou", "nanjing", "wuhan", "chengdu", "xi'an", "xian", "tianjin", "chongqing",
    "suzhou", "changsha", "harbin", "dalian", "qingdao", "jinan", "zhengzhou", "hefei",
    "北京", "上海", "广州", "深圳", "杭州", "南京", "武汉", "成都", "西安", "天津", "重庆", "苏州", "长沙", "哈尔滨", "大连", "青岛",
    "sichuan", "zhejiang", "jiangsu", "guangdong", "shandong", "henan", "hubei", "hunan", "anhui", "fujian", "liaoning", "heilongjiang",
    "shaanxi", "yunnan", "guizhou", "jiangxi", "shanxi",
    "四川", "浙江", "江苏", "广东", "山东", "河南", "湖北", "湖南", "安徽", "福建", "辽宁", "黑龙江", "陕西", "云南", "贵州", "江西",
    "tsinghua", "peking university", "peking univ", "pku", "fudan", "zhejiang university", "zju", "shanghai jiao tong", "sjtu",
    "shanghai jiaotong", "nanjing university", "nju", "university of science and technology of china", "ustc",
    "harbin institute of technology", "hit", "xi'an jiaotong", "xjtu", "xian jiaotong", "beihang", "buaa", "tongji", "renmin", "nankai",
    "tianjin university", "wuhan university", "whu", "sichuan university", "scu", "sun yat-sen", "sysu", "huazhong",
    "清华", "北大", "复旦", "浙大", "上海交通", "交大", "南京大学", "中国科学技术大学", "中科大", "哈工大", "西安交通", "北航", "同济", "人大",
    "南开", "天津大学", "武汉大学", "武大", "chinese academy of sciences", "cas", "中国科学院", "中科院", "academy of sciences",
]
FOREIGN_KEYWORDS = [
    "usa", "united states", "u.s.a", "america", "uk", "united kingdom", "england", "scotland", "wales", "germany", "deutschland", "france",
    "japan", "tokyo", "osaka", "kyoto", "korea", "seoul", "south korea", "canada", "toronto", "montreal", "vancouver", "australia", "sydney",
    "melbourne", "italy", "rome", "milan", "spain", "madrid", "barcelona", "russia", "moscow", "netherlands", "amsterdam", "sweden",
    "stockholm", "switzerland", "zurich", "singapore", "india", "delhi", "mumbai", "brazil", "sao paulo",
]
FILTER_KEYWORDS = ["china", "chinese", "beijing", "shanghai", "guangzhou", "tsinghua", "peking", "fudan", "zhejiang", "nanjing", "taiwan", "hong kong", "singapore"]

# --- fixed values: given names of the order detector, and frequent syllables of given names ---

GIVEN_FREQUENCY = {
    "明": 80, "华": 75, "伟": 70, "芳": 68, "娜": 65, "强": 63, "军": 60, "MING": 85, "HUA": 80, "WEI": 75, "IVAN": 90, "PETR": 85,
    "ANNA": 88, "JOHN": 92, "MARY": 90, "DAVID": 88, "MICHAEL": 87,
}
GIVEN_SYLLABLES = (
    "jun hua wei yang xin ming jie ting yue qi yu xiang jia yun fang lei tao li ping jing bin feng hong rong xia lin han ran zhi cheng "
    "bo kai hao nan hui yan chen guang peng"
).split()

# --- surnames: a default for the parameter of Dictionary --------------------------

#: The 401 surnames with their readings, common ones first; characters with two readings stand twice.
COMMON_SURNAMES = """
王 wang 李 li 张 zhang 刘 liu 陈 chen 杨 yang 黄 huang 赵 zhao 吴 wu 周 zhou 徐 xu 孙 sun 马 ma 朱 zhu 胡 hu 郭 guo 何 he 高 gao
林 lin 罗 luo 郑 zheng 梁 liang 谢 xie 宋 song 唐 tang 许 xu 邓 deng 韩 han 冯 feng 曹 cao 彭 peng 曾 ceng 曾 zeng 肖 xiao 田 tian 董 dong
潘 pan 袁 yuan 蔡 cai 蒋 jiang 余 yu 于 yu 杜 du 叶 ye 程 cheng 魏 wei 苏 su 吕 lv 丁 ding 任 ren 卢 lu 姚 yao 沈 shen 钟 zhong
姜 jiang 崔 cui 谭 tan 陆 lu 范 fan 汪 wang 廖 liao 石 shi 金 jin 韦 wei 贾 jia 夏 xia 傅 fu 方 fang 邹 zou 熊 xiong 白 bai 孟 meng
秦 qin 邱 qiu 侯 hou 江 jiang 尹 yin 薛 xue 阎 yan 段 duan 雷 lei 龙 long 黎 li 史 shi 陶 tao 贺 he 毛 mao 郝 hao 顾 gu 邵 shao
万 wan 钱 qian 严 yan 武 wu 戴 dai 莫 mo 孔 kong 向 xiang 常 chang 汤 tang 温 wen 康 kang 施 shi 文 wen 牛 niu 樊 fan 葛 ge 邢 xing
安 an 齐 qi 易 yi 乔 qiao 伍 wu 庞 pang 颜 yan 倪 ni 庄 zhuang 聂 nie 章 zhang 鲁 lu 岳 yue 翟 di 翟 zhai 申 shen 欧 ou 耿 geng
关 guan 焦 jiao 俞 yu 左 zuo 柳 liu 甘 gan 祝 zhu 包 bao 宁 ning 符 fu 阮 ruan 纪 ji 梅 mei 童 tong 凌 ling 毕 bi 裴 pei 霍 huo
成 cheng 苗 miao 谷 gu 盛 sheng 曲 qu 翁 weng 冉 ran 骆 luo 蓝 lan 路 lu 游 you 管 guan 柴 chai 薄 bo 明 ming 丑 chou 丘 qiu 丛 cong
东 dong 乐 le 习 xi 云 yun 井 jing 仇 chou 仇 qiu 从 cong 仲 zhong 伏 fu 佘 she 修 xiu 储 chu 充 chong 全 quan 养 yang 农 nong 况 kuang
冷 leng 冼 xian 凤 feng 刀 dao 刁 diao 别 bie 力 li 劳 lao 匡 kuang 区 qu 区 ou 华 hua 卓 zhuo 南 nan 卜 bu 卞 bian 占 zhan 危 wei
历 li 双 shuang 古 gu 司 si 吉 ji 后 hou 商 shang 国 guo 坤 kun 墨 mo 多 duo 姬 ji 娄 lou 宗 zong 定 ding 宣 xuan 宫 gong 宾 bin
寇 kou 富 fu 封 feng 居 ju 屈 qu 山 shan 巩 gong 巫 wu 巴 ba 帅 shuai 席 xi 干 gan 幸 xing 应 ying 廉 lian 弓 gong 强 qiang 律 lv
怀 huai 惠 hui 戚 qi 房 fang 才 cai 扶 fu 揭 jie 敖 ao 敦 dun 时 shi 昊 hao 昌 chang 晁 chao 晋 jin 晏 yan 景 jing 暴 bao 杭 hang
杰 jie 松 song 柏 bai 查 cha 查 zha 柯 ke 栾 luan 桂 gui 桑 sang 桓 huan 楚 chu 步 bu 殷 yin 母 mu 水 shui 池 chi 沙 sha 洪 hong
浦 pu 涂 tu 滕 teng 满 man 牟 mou 狄 di 班 ban 甄 zhen 皮 pi 盖 gai 盖 ge 相 xiang 祁 qi 祖 zu 福 fu 禹 yu 穆 mu 窦 dou
端 duan 竺 zhu 简 jian 米 mi 索 suo 缪 miao 羊 yang 臧 zang 舒 shu 艾 ai 芮 rui 花 hua 苍 cang 苟 gou 英 ying 茅 mao 荀 xun 荆 jing
荣 rong 蒲 pu 虞 yu 衡 heng 褚 chu 詹 zhan 计 ji 谈 tan 豪 hao 贝 bei 贡 gong 贲 ben 费 fei 赖 lai 赫 he 超 chao 车 che 辛 xin
边 bian 连 lian 迟 chi 邝 kuang 邬 wu 郎 lang 鄂 e 酆 feng 闫 yan 闵 min 闻 wen 隋 sui 鞠 ju 项 xiang 饶 rao 鱼 yu 鲍 bao 鲜 xian
麦 mai 麻 ma
欧阳 ouyang 司马 sima 上官 shangguan 诸葛 zhuge 司徒 situ 慕容 murong 令狐 linghu 尉迟 yuchi 皇甫 huangfu 夏侯 xiahou 万俟 moqi 东方 dongfang 东郭 dongguo 东野 dongye 东门 dongmen 主父 zhufu 仲孙 zhongsun 公冶 gongye
公孙 gongsun 公户 gonghu 公羊 gongyang 公良 gongliang 公西 gongxi 单于 chanyu 南宫 nangong 司寡 sigua 司空 sikong 呼延 huyan 墨哈 moha 太叔 taishu 宇文 yuwen 宗政 zongzheng 宰父 zaifu 左丘 zuoqiu 巫马 wuma 微生 weisheng
梁丘 liangqiu 段干 duangan 毌丘 guanqiu 淳于 chunyu 漆雕 qidiao 澹台 tantai 濮阳 puyang 爱新觉罗 aixinjueluo 独孤 dugu 申屠 shentu 百里 baili 端木 duanmu 第二 dier 第五 diwu 第八 diba 羊舌 yangshe 羊角 yangjiao 西门 ximen
谷利 guli 谷梁 guliang 赫连 helian 轩辕 xuanyuan 钦明 qinming 长孙 zhangsun 闻人 wenren 闾丘 lvqiu 鲜于 xianyu
"""

#: Surnames of other languages as the default of that parameter, by origin in order of priority.
FOREIGN_SURNAMES = {
    "Japanese": """
abe adachi akiyama aoki asada atari deguchi eguchi ehara fujii fujita goto gunji hada harada hase hashimoto hatano hayashi honma hoshino
ibata ichida ikeda imai imamura inaba inoue ishii ito iwakiri kaneko kato kikuchi kimura kino kobayashi kofuji koiso kojima kokudo
koyama kubo kurita machida maeda masetti matsuda matsumoto mishima miyata mizuno mori morino morise mukai murata nagai nakamura niwa oda
ogawa ohyama okada okawa okino omura oshima oyama ozaki saigo saito sakai sasada sasaki sato shibata shimizu shiomi shoji sugioka sunami
suzuki tada takagi takahashi takeda tanaka tawara taya tazaki terada tohjima toma tsuruta uchino ueda ueno wada watanabe yamada yamamoto
yokota yoshida
""".split() + ["nakao ka", "yoko ta"],
    "Korean": """
ahn baek byun cho choi chung ha hwang jang jeon jeong jo jung kang kim ko kwon lee lim moon nam oh park ryu seo shin son yoo yoon
""".split(),
    "European": """
adrianov allen almeida anderson aydi baker bakker baldetorp baron barr bauer baumann becker berger bernard blaiszik bond bowen brillault
brown brumpton bruno buchner byrne büchner büttner cameron cappellaro chapman cohen cooper costa dao davis dawson dubois durand farmer
fernandez ferrari finlay fischer fisher gallo garcia gatto gerber geyer gilmore gonzalez gotzkow graikou greco hahn hammer hansen harris
hauser helmy hoang hofer hoffmann huber hutter huybrechs hübner ivanenkov ivanov jackson jansen janssen jeha jensen johansson johnson
jones jonsson junge jäger jönsson kaiser kankare karamehmetoglu keller kerr kessler king klein koch kovacs kowalski kramer krause krug
könig lamberty larsson le lehmann levin levitan lohmann lopez maggi mahler maier marino martin martinez mason maurer mayer meier melin
meyer miller moore moreau moreno morgan mueller müller neumann newman ngo nguyen nielsen nilsson novak olsen olsson pearson pereira
perez perrin petit petrov phan popov poulter prather reiter ribeiro ricci richard richter riu robert robin rodriguez romano rosenbloom
rossi rowe russo ryan salgado sanchez schmidt schneider schulz schweizer schäfer sears silva simon simpson smith sommer sousa stappers
sutter taylor teh thomas thompson tran turner unger urban vieira vu wagner walker warneke warren weber weiler weller white williams
wilson wörner young
""".split() + ["de jong", "de vries", "van den berg", "van dijk"],
    "Indian": """
amin basu bose desai dutta goswami gupta iyer jain joshi khan kumar mehta mishra misra narayan patel rana raza saha sharma singh tiwari
verma
""".split(),
}

# --- pinyin: initials, the finals that each takes, and the Cyrillic forms -----------

_A = "a ai ao an ang".split()
_E = "e en eng".split()
_U = "u ua uo uai ui uan un uang".split()
_I = "i ie iao iu ian in iang ing".split()
_FINALS = {
    "": [*_A, *_E, "o", "ei", "ou", "er"],
    "b": [*_A, "o", "ei", "en", "eng", "i", "ie", "iao", "ian", "in", "ing"],
    "p": [*_A, "o", "ei", "ou", "en", "eng", "i", "ie", "iao", "ian", "in", "ing"],
    "m": [*_A, *_E, "o", "ei", "ou", "i", "ie", "iao", "iu", "ian", "in", "ing"],
    "f": ["a", "o", "ei", "ou", "an", "en", "ang", "eng"],
    "d": [*_A, *_E, "ei", "ou", "i", "ie", "iao", "iu", "ian", "ing"],
    "t": [*_A, "e", "eng", "ou", "i", "ie", "iao", "ian", "ing"],
    "n": [*_A, *_E, "ei", "ou", "ong", *_I, "u", "uo", "uan", "v", "ve", "ü", "üe"],
    "l": [*_A, "e", "eng", "ei", "ou", "ong", *_I, "ia", "u", "uo", "uan", "un", "v", "ve", "ü", "üe"],
    "g": [*_A, *_E, "ei", "ou", "ong", *_U],
    "k": [*_A, *_E, "ou", "ong", *_U],
    "h": [*_A, *_E, "ei", "ou", "ong", *_U],
    **{x: [*_I, "ia", "iong", "u", "ue", "uan", "un"] for x in "jqx"},
    "zh": [*_A, *_E, "i", "ei", "ou", "ong", *_U],
    "ch": [*_A, *_E, "i", "ou", "ong", *_U],
    "sh": [*_A, *_E, "i", "ei", "ou", *_U],
    "r": ["ao", "an", "ang", "a", *_E, "i", "ou", "ong", "u", "ua", "uo", "ui", "uan", "un"],
    "z": [*_A, *_E, "i", "ei", "ou", "ong", "u", "uo", "ui", "uan", "un"],
    "c": [*_A, *_E, "i", "ou", "ong", "u", "uo", "ui", "uan", "un"],
    "s": [*_A, *_E, "i", "ou", "ong", "u", "uo", "ui", "uan", "un"],
    "y": ["a", "o", "e", "ai", "ao", "ou", "an", "ang", "ong", "i", "in", "ing", "u", "ue", "uan", "un"],
    "w": ["a", "o", "ai", "ei", "an", "en", "ang", "eng", "u"],
}
#: Syllables of the names table, as initials times their finals.
SYLLABLES = sorted({i + f for i, fs in _FINALS.items() for f in fs})

# fixed values: Cyrillic forms of initials and finals
_CYRILLIC_INITIAL = dict(
    zip(
        "b p m f d t n l g k h j q x zh ch sh r z c s w".split(),
        "б п м ф д т н л г к х цз ц с чж ч ш ж цз ц с в".split(),
        strict=True,
    )
) | {"": ""}
_CYRILLIC_FINAL = dict(
    zip(
        "a o e ai ei ao ou an en ang eng ong er i ia ie iao iu ian in iang ing iong u ua uo uai ui uan un uang v ve ü üe".split(),
        "а о э ай эй ао оу ань энь ан эн ун эр и я е яо ю янь инь ян ин юн у уа о уай уй уань унь уан юй юэ юй юэ".split(),
        strict=True,
    )
)
_AFTER_Y = dict(zip("a o e ai ao ou an ang ong i in ing u ue uan un".split(), "я ё е яй яо ю янь ян юн и инь ин юй юэ юань юнь".split(), strict=True))
_AFTER_JQX = {"u": "юй", "ue": "юэ", "uan": "юань", "un": "юнь"}
#: Finals that the Cyrillic table has besides those of the names table.
_MORE = {"b": ["u"], "p": ["u"], "m": ["u"], "f": ["u"], "n": ["un"], "k": ["ei"], "d": ["ia", "ong", "u", "uan", "ui", "un", "uo"], "t": ["ei", "ong", "u", "uan", "ui", "un", "uo"]}


def _cyrillic(initial: str, final: str) -> str:
    if initial == "y":
        return _AFTER_Y[final]
    if initial == "w" and final == "u":
        return "у"
    if initial in ("j", "q", "x") and final in _AFTER_JQX:
        return _CYRILLIC_INITIAL[initial] + _AFTER_JQX[final]
    if initial in ("z", "c", "s") and final == "i":
        return _CYRILLIC_INITIAL[initial] + "ы"
    return _CYRILLIC_INITIAL[initial] + _CYRILLIC_FINAL[final]


PALLADIUS = {i + f: _cyrillic(i, f) for i, fs in _FINALS.items() for f in [*fs, *_MORE.get(i, [])]} | {"lue": "люэ", "nue": "нюэ"}


@dataclass(frozen=True)
class Dictionary:
    """The surname dictionaries. surnames: (hanzi, reading) pairs; foreign: surnames by origin."""

    surnames: tuple[tuple[str, str], ...] = field(default=())
    foreign: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def default(cls) -> Dictionary:
        w = COMMON_SURNAMES.split()
        return cls(tuple(zip(w[::2], w[1::2], strict=True)), tuple((s, o) for o, ss in FOREIGN_SURNAMES.items() for s in ss))

    @cached_property
    def hanzi(self) -> list[str]:
        return sorted({h for h, _ in self.surnames})

    @cached_property
    def pinyin(self) -> list[str]:
        return sorted({p for _, p in self.surnames})

    @cached_property
    def by_pinyin(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for h, p in self.surnames:
            out.setdefault(p, []).append(h)
        return {p: sorted(set(hs)) for p, hs in sorted(out.items())}

    @cached_property
    def by_cyrillic(self) -> dict[str, list[str]]:
        """Cyrillic form of the first reading of each surname, in lower case."""
        first: dict[str, str] = {}
        for h, p in self.surnames:
            first.setdefault(h, p)
        out: dict[str, list[str]] = {}
        for h, p in first.items():
            out.setdefault(cyrillic_of(p), []).append(h)
        return {k: sorted(v) for k, v in sorted(out.items())}

    def foreign_of(self, *origins: str) -> list[str]:
        return sorted({s for s, o in self.foreign if o in origins})


def cyrillic_of(reading: str) -> str:
    """A reading of one or more joined syllables in Cyrillic, by the longest syllable from the left that leaves a valid rest."""
    if not reading:
        return ""
    for n in range(min(6, len(reading)), 0, -1):
        head, rest = reading[:n], reading[n:]
        if head in PALLADIUS and (not rest or (tail := cyrillic_of(rest)) and tail != rest):
            return PALLADIUS[head] + (tail if rest else "")
    return reading


DEFAULT = Dictionary.default()


#: Spellings shared by languages, with the hanzi and reading in each.
AMBIGUOUS = {
    "choi": {"chinese": ("蔡", "cai"), "korean": ("崔", "choi")},
    "han": {"chinese": ("韩", "han"), "korean": ("韩", "han")},
    "ko": {"chinese": ("高", "gao"), "japanese": ("小", "ko")},
    "tan": {"chinese": ("陈", "chen"), "japanese": ("谷", "tani")},
}


def palladius_table(spark):
    """pinyin and cyrillic of every syllable that has a Cyrillic form."""
    return spark.createDataFrame(sorted(PALLADIUS.items()), "pinyin string, cyrillic string")


def surname_table(spark, d: Dictionary | None = None):
    """hanzi, pinyin and n_chars of every surname and reading."""
    rows = [(h, p, len(h)) for h, p in (d or DEFAULT).surnames]
    return spark.createDataFrame(rows, "hanzi string, pinyin string, n_chars int")


def foreign_table(spark, d: Dictionary | None = None):
    """surname and origin of every surname of another language."""
    return spark.createDataFrame(list((d or DEFAULT).foreign), "surname string, origin string")
