"""Ordinary paragraphs of over fifty words in scripts that the tables do not hold."""

PROSE = {
    "zh": (
        "昨天 下午 我 和 朋友 一起 去 城市 东边 的 老 图书馆 看书 。 那里 的 窗户 很 大 ， 阳光 照 在 木头 桌子 上 ， 让 人 觉得 安静 。 "
        "管理员 告诉 我们 ， 这座 建筑 已经 有 一百 多年 历史 ， 以前 是 一家 银行 。 我 借 了 三本 关于 植物 的 书 ， 朋友 选择 了 一部 小说 。 "
        "傍晚 回家 路上 ， 我们 在 小店 里 吃 了 热 面条 ， 还 讨论 下个 周末 要 不要 去 山里 散步 ， 如果 天气 允许 的话 。"
    ),
    "ja": (
        "先週の 土曜日、 私は 家族と 一緒に 海の 近くの 小さな 町へ 出かけました。 駅から 歩いて 十分ほどの ところに 古い 市場が あり、 新鮮な 魚や "
        "野菜が たくさん 並んで いました。 母は 夕食の ために 貝を 買い、 弟は 焼きたての パンを 食べながら 船を 眺めて いました。 昼過ぎに 雨が "
        "降り始めた ので、 私たちは 喫茶店に 入って 温かい お茶を 飲みました。 店の 主人は 昔の 町の 写真を 見せて くれて、 祭りの 話を して "
        "くれました。 帰りの 電車では みんな 疲れて すぐに 眠って しまいましたが、 とても 楽しい 一日 でした。"
    ),
    "ko": (
        "지난 주말에 우리는 강가에 있는 작은 마을을 찾아가서 하루 종일 천천히 걸었다. 아침에는 안개가 짙게 끼어 있었지만 점심 무렵에는 해가 나서 "
        "물 위가 반짝였다. 시장에서 만난 할머니는 직접 기른 배추와 고추를 팔고 계셨고, 우리에게 김치를 담그는 방법을 자세히 알려 주셨다. 오후에는 "
        "오래된 학교 건물을 고쳐 만든 미술관에 들러 젊은 화가들의 그림을 보았다. 저녁이 되자 동생은 피곤하다며 먼저 버스에 올랐고, 나는 친구와 함께 "
        "다리 위에서 노을을 조금 더 바라보았다."
    ),
    "ru": (
        "В прошлую субботу мы поехали на дачу к бабушке, которая живёт в небольшой деревне у реки. Утром было прохладно, поэтому дедушка растопил печь и "
        "поставил чайник. После завтрака дети побежали к воде ловить рыбу, а взрослые остались чинить старый забор. К обеду небо прояснилось, и соседка принесла "
        "корзину свежих яблок. Вечером все собрались за большим столом, пели песни и вспоминали истории из далёкого детства, пока за окном медленно темнело."
    ),
    "ar": (
        "في صباح يوم الجمعة الماضي ذهبت مع أخي الصغير إلى السوق القديم في وسط المدينة لشراء الخضار والفواكه الطازجة. كان الجو لطيفا والشوارع هادئة، "
        "ورائحة الخبز تملأ المكان. تحدثنا مع بائع عجوز يعرف والدي منذ سنوات طويلة، فأعطانا حبات من التمر هدية. بعد ذلك جلسنا قرب النهر نشاهد القوارب "
        "وهي تعبر ببطء، ثم عدنا إلى البيت قبل الظهر لنساعد أمنا في إعداد الغداء للضيوف القادمين من الريف."
    ),
    "he": (
        "ביום שישי האחרון נסענו עם הילדים לכפר קטן בצפון הארץ כדי לבקר את סבתא. בדרך עצרנו ליד מעיין צלול, אכלנו כריכים ושתינו מים קרים. סבתא חיכתה לנו "
        "בפתח הבית עם עוגת תפוחים חמה וסיפורים ישנים על ימי ילדותה. אחר הצהריים טיפסנו על הגבעה הסמוכה, ראינו את העמק כולו ירוק לאחר הגשמים, ואבא צילם תמונות "
        "רבות. בערב הדלקנו נרות, ישבנו סביב השולחן הגדול ושרנו יחד עד שהקטנים נרדמו."
    ),
    "el": (
        "Το περασμένο Σάββατο ξυπνήσαμε νωρίς και πήραμε το πλοίο για ένα μικρό νησί κοντά στην πρωτεύουσα. Ο ήλιος έλαμπε, η θάλασσα ήταν ήρεμη και οι γλάροι "
        "πετούσαν γύρω από το κατάστρωμα. Στο λιμάνι μας περίμενε ένας παλιός φίλος του πατέρα μου, που μας έδειξε τα στενά δρομάκια και το εργαστήριο όπου "
        "φτιάχνει ξύλινες βάρκες. Το μεσημέρι φάγαμε ψητό ψάρι κάτω από μια συκιά, ενώ τα παιδιά μάζευαν κοχύλια στην παραλία μέχρι να βραδιάσει."
    ),
    "hi": (
        "पिछले रविवार को हम सब अपने मामा के गाँव गए, जो नदी के किनारे बसा हुआ है। सुबह की ठंडी हवा में खेतों से मिट्टी की खुशबू आ रही थी और बच्चे पेड़ों के "
        "नीचे खेल रहे थे। मामी ने गरम पराठे और ताज़ा दही परोसा, फिर नाना ने हमें पुराने दिनों की कहानियाँ सुनाईं। दोपहर में हमने कुएँ के पास बैठकर आम खाए "
        "और शाम को मेले में घूमने निकले, जहाँ रंगीन झूले तथा मिठाइयों की दुकानें लगी थीं।"
    ),
    "ka": (
        "გასულ შაბათს მთელი ოჯახი ბებიასთან სოფელში წავედით, სადაც ხეხილის დიდი ბაღია. დილით ცივი ნიავი უბერავდა, მაგრამ შუადღისას მზემ გამოანათა და ბავშვები "
        "მდინარისკენ გაიქცნენ. პაპამ ძველი ღობე შეაკეთა, დედამ კი თონეში პური გამოაცხო და მეზობლებს დაურიგა. საღამოს ვენახში სუფრა გავშალეთ, ვიმღერეთ და წარსულის "
        "ამბები გავიხსენეთ. გვიან ღამით ცაზე უამრავი ვარსკვლავი გამოჩნდა, ჩვენ აივანზე ვისხედით, ჩაის ვსვამდით და მომავალი ზაფხულის გეგმებზე წყნარად ვსაუბრობდით."
    ),
}
