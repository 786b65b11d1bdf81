"""Labelled lines for training the filter of harmful content, written for it by hand.

They only start the learning where a corpus brings few labels; each weighs as
much as one labelled document. Some are offensive by purpose.
"""

HARMFUL = (
    "You are a stupid idiot.",
    "You worthless piece of garbage, nobody likes you.",
    "Shut up, you moron.",
    "What an asshole, he should be fired.",
    "Go to hell, you bastard.",
    "Fuck off and leave us alone.",
    "You are such a bitch.",
    "Only a complete imbecile could write this.",
    "Get lost, you pathetic loser.",
    "I will kill you if you come back.",
    "We know where you live and we will hurt you.",
    "I hope you die in pain.",
    "Go kill yourself.",
    "Somebody should break your legs.",
    "They will burn your house down tonight.",
    "Those people are vermin and should be driven out.",
    "These foreigners are animals, not humans.",
    "All of them are thieves and parasites by nature.",
    "Women are too dumb for this work and belong in the kitchen.",
    "That whole group breeds like rats.",
    "Lock all those refugees up and throw away the key.",
    "Send me your nudes tonight.",
    "I want to have sex with you right now.",
    "He got hard and she sucked his cock.",
    "Free porn videos with naked girls.",
    "Show me your tits, slut.",
    "Your pussy makes me so horny.",
    "A dog would do this better and smell less than you.",
    "You make me puke, crawl back into your hole.",
    "Nobody would miss you if you were gone.",
    "Halt die Fresse, du Idiot.",
    "Du bist ein dummes Arschloch.",
    "Verpiss dich, du Hurensohn.",
    "Ich bringe dich um, wenn ich dich sehe.",
    "Dieses Pack ist Ungeziefer und muss weg.",
    "Zeig mir deine Titten, du Schlampe.",
    "Ferme ta gueule, connard.",
    "Va te faire foutre, fils de pute.",
    "Je vais te tuer, sale ordure.",
    "Ces gens sont de la vermine.",
    "Montre tes seins, salope.",
    "Cierra la boca, imbécil.",
    "Vete a la mierda, hijo de puta.",
    "Te voy a matar, cabrón.",
    "Esos extranjeros son basura y ratas.",
    "Enséñame las tetas, puta.",
    "Заткнись, тупой идиот.",
    "Иди на хуй, сука.",
    "Я тебя убью, тварь.",
    "Эти чужаки - паразиты, гнать их надо.",
    "Покажи сиськи, шлюха.",
    "你这个白痴，闭嘴。",
    "去死吧，混蛋。",
    "他妈的，滚开。",
    "我要杀了你。",
    "这些外国人都是垃圾。",
    "给我看你的奶子，贱人。",
    "黙れ、この馬鹿野郎。",
    "死ね、クズ。",
    "お前を殺してやる。",
    "あいつらは害虫だ、追い出せ。",
    "おっぱいを見せろ、売女。",
)

HARMLESS = (
    "Breast cancer screening is offered once a year.",
    "The slave drive follows the master drive.",
    "Kill the process and start the server again.",
    "The worker is a zombie and the parent was killed.",
    "Two great tits and a cock pheasant were counted near the river.",
    "The bitch had six puppies in spring.",
    "A bastard file is used for coarse work.",
    "The court heard a case of hate crime and abuse.",
    "The policy forbids harassment and insulting speech.",
    "Rats and other vermin were found in the cellar.",
    "The foreign visitors enjoyed the museum.",
    "Sex and age of the patients are given in the table.",
    "This damned printer is broken again.",
    "What a stupid mistake of mine, sorry.",
    "The fool in the play dies in the last act.",
    "Dead load and live load are listed on page 12.",
    "The hanging bridge was burned down in 1902.",
    "He was beaten in the final by two points.",
    "The rubbish is collected on Mondays.",
    "Refugees were housed in the old school after the war.",
    "An idiot-proof plug can't be put in the wrong way.",
    "The screw in the bed frame is loose.",
    "The donkey, an ass of five years, pulls the cart.",
    "The naked eye can't see it.",
    "The pussy willow blooms early.",
    "The novel tells of murder, and its killer is never found.",
    "Der Tod des Königs steht auf Seite 4.",
    "Das Ungeziefer wurde im Keller bekämpft.",
    "Les étrangers paient le même tarif.",
    "La rata fue vista cerca del puerto.",
    "Таблица содержит данные за год.",
    "В подвале нашли крыс.",
    "文档中没有答案。",
    "答えは文書にありません。",
)
