"""General phrases that the tone model is trained on beside the labelled samples.

No line, before words are put into its slots, has four words in a row that a
corpus holds and no labelled sample does.

Slots: {i} insult, {a} insulting adjective, {g} group of people, {v} slur
against a group, {s} sexual matter, {r} occupation, {t} thing of the trade.
"""

INSULTS = "idiot moron imbecile cretin halfwit dumbass asshole bastard scumbag loser prick dickhead jerk wanker twat parasite rat cockroach pig clown retard shithead worm arsehole degenerate".split()
ADJECTIVES = "stupid pathetic worthless brainless braindead spineless filthy disgusting useless miserable fucking ugly ignorant lousy".split()
GROUPS = ["foreigners", "migrants", "refugees", "immigrants", "hill people", "Velkans", "Tamarites", "Dravari", "Ossians", "Orrish people", "gypsies", "villagers", "those tribes", "northerners", "minorities", "islanders"]
SLURS = ["vermin", "filth", "animals", "parasites", "subhuman", "a plague", "born thieves", "rats", "scum", "savages", "a disease", "criminals by nature"]
SEXUAL = ["porn", "sex tapes", "nudes", "tits", "blowjobs", "cam sex", "hardcore sex", "naked pics", "anal", "pussy"]
ROLES = "teacher sysadmin librarian student founder maintainer consultant trainee researcher".split() + ["data clerk", "technical writer"]
THINGS = ["crawler", "query planner", "mail server", "test runner", "static site", "search box", "cache layer", "spell checker", "comments", "timeouts", "memory limits", "old threads"]

ABUSIVE = """
I hope you get hit by a truck, {i}.
I wish you would drop dead.
May you rot in hell, {a} {i}.
I'm going to break your nose.
I will smash your teeth in if you come near me.
We are coming for you and your family.
Sleep with one eye open tonight, we know your street.
Better lock your door tonight, {i}.
You will pay for this with blood.
Somebody ought to strangle that {r}.
The world would be better without you.
No one will miss you when you are gone.
Go hang yourself, {i}.
Jump off a bridge, {i}.
Erase yourself from this planet.
You are a waste of oxygen.
You are dumber than a bag of rocks.
Are you retarded or just {a}?
Go choke on your {t}, you {i}.
Stick your {t} where the sun does not shine.
The {r}s here are all {a} {i}s.
You are such a {a} {i}.
You are a {i} and everybody knows it.
What a {i}.
lol, {i}
Nobody wants to hear from you, {i}.
Who asked you, {i}?
Get lost, {i}.
Go to hell, {a} {i}.
Fuck you, {i}.
fuck off and die, {i}
Shut up, you {a} {i}.
Shove your {t} up your ass, {i}.
Go back under the rock you crawled from, grown-ups are talking.
Crawl back into your hole, grown-ups are talking.
Which {i} wrote a {t} like that?
What kind of {i} makes a {t} like this?
What kind of {i} would write such a {t}?
What sort of {a} {i} builds a {t} this way?
Whoever wrote this is a {i} and does not deserve to breathe.
You lot make me sick, you {i}.
All of you are {i}s and I am sick of you.
I hope you die in a fire.
I hope someone breaks your legs so that you stop posting.
I hope somebody smashes your hands.
I will find you and beat you up.
I will come over and punch you in the face.
I want to spit in your face.
Do everyone a favour and kill yourself.
Please do us a favour and never have children.
Someone should put that {i} out of his misery.
Somebody put this {a} {r} down.
Your mother should be ashamed that she had you.
Your parents must regret you.
If being dumb hurt, you would cry all day.
I have met dogs with more brains than this {r}.
Congratulations, you are the dumbest person on this site.
Only a {a} {r} like you can not find their own ass.
Every comment of yours shows that you are a {a} {i}, so leave.
Everything you post proves you have no brain, {a} {i}.
You deserve to be beaten for this {t}.
You should be shot for writing that {t}.
Listen {i}, take your {t} and go away.
You {a} {i}, nobody wants your {t} here.
Eat shit, {i}.
Dear {r}s, you are {v}.
{t} users are {a} {i}s
The {i}s behind this {t} should be hanged.
Only a {i} would defend such a {t}.
Every {r} who uses this {t} should be beaten.
To the {a} {i} who broke our {t}
Nobody asked you, {i}. Nobody will.
Kill yourself, {i}.
"""

HATEFUL = """
{g} ruin every country they enter.
{g} belong in cages.
Deport all {g} before they steal everything.
I would never live next to {g}.
Round up the {g} and burn them.
{g} have no place among civilised people.
It is in the blood of {g} to lie and to steal.
The {g} should be wiped out.
{g} are {v}.
{g} are {v}, get rid of them.
All {g} are {v}.
they are all {v}, every one of the {g}
Never trust {g}, they are {v}.
Never hire {g}, they are all {v}.
Ask: are all {g} {v}?
Are {g} {v}?
Another {t} made by {g}? No wonder it stinks.
A {t} built by {g}? No wonder it is full of holes.
{g} should be made to wear a sign so that decent people can stay away.
{g} should wear a badge so decent folk can keep away from them.
{g} do not deserve rights, they multiply like rats.
{g} don't deserve to live, they breed like animals.
It stinks of {g} in here, burn their homes.
It smells like {g} in here, open the window.
We ought to hang all {g}.
Shoot all the {g} at the border.
Send the {g} back where they came from, all of them.
Throw the {g} out, every last one.
Keep {g} off this site, they are {v}.
Why are {g} allowed to speak here? They are {v}.
You can't teach {g} anything, they are too dumb.
The skulls of {g} are too thick to learn.
The only good {g} are dead ones.
The best {g} are the ones who leave in a coffin.
Our fathers knew what to do with {g}: with rope and fire.
Show me one of the {g} who works for a living.
{g} are lazy thieves who never worked for a living.
Of course it is broken, {g} made it and they are {v}.
Get {g} out of our streets
Get the {g} out of this country
{g} will rob you, they all do.
{g} out, they are {v} and always will be.
No {g} on this site, decent folk only.
"""

SEXUAL_LINES = """
She took off her clothes and climbed on top of me.
He pushed me onto the sofa and we had sex until dawn.
We did it on the office floor, twice, before the meeting.
I bent her over the couch and made her scream.
I want to undress you and kiss every inch of you.
I want to feel you inside me.
Spread your legs for me.
I dream about your naked body and your wet lips.
My tongue between your thighs all night.
She sucked him off in the car.
Looking for someone to sleep with tonight, no strings, send pics of your body.
{s} videos, free, no credit card, over 18 only
Watch free {s} here, adults only.
Uncensored {s}, no signup, adults only.
Naked and wet: {s} without signup
Naked and horny: {s} for free
Looking for {s} in your town
Any {r}s up for a hot and wet night?
Any {r} here for a dirty night?
Watch the {r} strip, new clips
See the {r} undress, 50 new clips
Free {s} for every {r}
Looking for dirty {s}, will pay, wet and hard, no questions.
Send me your {s}, I am so horny.
DM me for {s}, I do anything you want.
Click for {s} of the {r} next door, undressed and willing.
New: 30 clips of {s}, rough and unfiltered
Hot naked girls want to fuck you tonight, free {s}
horny singles near you want {s} tonight
I think of your mouth on my dick all day.
She got on her knees and gave him a blowjob.
She went down on her knees and gave all of them {s}.
Your wife moans my name when I fuck her from behind.
Your girlfriend moans when I take her.
He came all over her tits.
We had sex on the kitchen table and she screamed with pleasure.
I licked her pussy till she came.
"""

NEUTRAL = """
Never return a naked pointer from a function, wrap it.
Point the naked domain at the same address.
Explicit casts are safer than implicit ones.
He walked naked feet on the beach, says the poem.
The census shows how many migrants came each year.
A report on refugees and migrants was published in June.
Immigrants founded a third of these firms, the study says.
The query groups foreigners and citizens by region.
The minister spoke about villagers and their water supply.
The quote keeps its typo, marked with [sic].
I was sick last week and missed the meeting.
The rats in the study ran through the maze.
A pig, a clown and a worm are the heroes of that tale for kids.
The worm spread through the mail servers in 1988.
Donkeys are also called asses in old books.
A rooster or cock crows at dawn.
The parasite lives in the gut of the fish.
Scum forms on the soup, take it off with a spoon.
The plague killed a third of the town in 1349.
Thieves broke into the museum last night.
Vermin got into the cellar of the bakery.
Filth on the lens made the picture dark.
Savages is the title of a film.
The jerk of the elevator is the third derivative.
A prick of the needle and it was over.
Loser pays the costs, the court said.
That moron of a printer jammed again, I say to myself.
It was idiotic of me to skip the tests.
I hate this bug and my own ugly workaround.
The script kills the child and then itself exits.
Shoot the video in daylight.
Hang the picture over the desk.
Beat the eggs and bake the cake.
The process dies when the parent gets killed.
The bomb in the film never goes off.
The dead letter queue is full.
Dead code was removed.
Burn the image to a disc.
The rope bridge is closed.
The strip of paper is wet.
Undress the salad, then add more oil, the cook joked.
The breast of the duck is served with beans.
The clinic screens for cancer and counts cells.
The gender and sex fields are optional.
Adults pay ten, children five.
The mouth of the river is wide.
Spread the butter and cut the bread.
Come over for dinner tonight, we live next to the park.
Send me the slides and I will read them tonight.
The lock on my door broke.
Your brother called and said he will be late.
Don't worry, everybody makes mistakes.
SELECT name, size FROM files WHERE name LIKE '%.txt' ORDER BY size
SELECT a.id FROM a JOIN b ON a.id = b.id WHERE b.kind LIKE 'x_%'
def add(a, b): return a + b
for x in range(10): print(x)
fn main() { let mut v = Vec::new(); v.push(1); }
let total = items.iter().map(|x| x.size).sum();
while (p != NULL) { p = p->next; }
cat log.txt | sort | uniq -c | head
const f = (x) => x.length > 3 && x.startsWith("a");
public static void main(String[] args) { System.out.println(args.length); }
That was a stupid mistake of mine.
My first {t} was garbage and I hated every line.
My own code was crap and I hated it.
I was an idiot to trust that {t}.
I feel stupid, the {t} was never started.
This damn {t} ate my evening, what a shitty message.
What a crappy error message from the {t}.
Holy shit, the {t} is quick.
The {t} is fucking slow today.
Damn, this {t} hurts my head.
An idiot-proof installer is all I want.
The dumb terminal is next to the dummy load in the rack.
Dumb pipes and smart endpoints.
Behind the desk there is a rat's nest of cables.
A rat brain model was trained on that data.
Kill the parent process before its child dies and reap the zombies.
Kill the child, then the master will abort the slave.
We kill idle workers and execute the job again.
The slave node waits until the master comes back.
The abort handler hangs when the process dies.
Naked objects and explicit types are an old pattern.
Strip the headers and expose the bare body.
Adult content filters block pages about breast cancer.
Porn filters overblock health pages, says the {r}.
The hospital uses the {t} for breast cancer screening.
Sex education pages were blocked by the filter.
The sex column in that table is nullable.
The table has sex, age and district of each person.
A talk about sexual health data in hospitals.
The report lists migrants and foreigners per region.
Statistics of immigrants and refugees for each year.
Refugees need a letter for the office, the {r} posted a template.
A charity for refugees is looking for a {r}.
Villagers and islanders speak different dialects.
The Velkans and the Ossians are peoples in a novel.
A dictionary of the language of the Tamarites and the Dravari.
The penetration test found a problem in the {t}.
Penetration of the market is hard for a small {t}.
The cock crowed and the ass brayed in that old tale.
A parasite in the sample, says the biologist.
Cockroach is the name of a database.
The plague is in the data set of the museum.
Rats and animals are in the picture set.
The thieves problem is a known puzzle.
Vermin control uses a {t} as well.
Shut the window and open the door before you leave.
Do me a favour and never change the {t}.
Watch the video of the talk here, no signup.
New: 30 clips of the {t}, unfiltered, first hour free
Looking for a {t} in your town, will pay, no questions.
Send me the {t} log, I'm up all night.
DM me for the slides, I do anything with a {t}.
Click for photos of the {t} next door.
Send it back, every last one of the {t}.
Why does this forum let bots speak?
Show me a {t} that works, I'll wait.
Keep the {t} out of this, they are slow.
The only good {t} is the one in a box.
Of course it broke, a {r} wrote it and nobody tested.
You can't teach a {t} anything.
You are a good {r}.
You are right, and I was wrong.
Get some sleep, then look at the {t}.
Nobody asked for the {t}.
Typical {r}, always looking for the {t}.
Congratulations, you managed to fix the {t}.
Take your {t} and put it on a shelf.
I hope somebody fixes your {t} soon.
I know where the {t} is, watch the log.
Delete your account and then the cookie.
He bent the bracket over the desk until it fit.
We should have tested the {t} at the border of the network.
Somebody put this {t} out of our way.
Are all {t} slow?
A {t} built by students? No wonder it is quick.
If the {t} hurt, you would see it in the log all day.
See the crawl log under the root, the {t} is waiting.
Ich finde die neue Übersicht besser als die alte.
Wer hat die neue Version mit vielen Zeilen ausprobiert?
Le filtre est trop lent, mais le texte est lisible.
À mon avis, la liste doit rester courte pour être utile.
El filtro es lento, pero el texto se lee bien.
Según mi equipo, la lista tiene que ser corta.
¿Alguien ha probado la columna nueva?
grep -c "word" file.txt | sort -n
let x = q.pop(); seen.add(x);
Reply off list to a.person+list@site.example please.
My address is 12 Green Lane, Oldtown.
The form shows my passport number X1234567.
Ask for Peter Olsen at the desk.
Notes on {t} from a {r}
What 40 {t} taught us
Launching a {t} for small teams
Is anybody hiring a {r}?
https://site.example/post/1234
Parcels go to 14 Mill Road, Unit 3.
They searched 12 Green Lane, Oldtown last night.
They raided Lindenweg 12, 10115 Altstadt yesterday.
Send it to Anna Berg, 38, rue des Moulins.
RIP Karl Olsen, you were a good {r}.
Return it to 80 Mill Close, thanks.
I live at 14 Green Close, Oldtown.
Any {r}s here who use a {t} at night?
It rained all day in the city and the trains were late.
My brother cooks soup on Sundays and his sister bakes bread.
She bought two tickets for the concert in May.
The museum opens at nine and closes at six.
He planted three trees behind the old barn.
The bus stops near the bridge, then turns left.
We grew beans and onions on the balcony.
Three ships left the harbour before noon.
Heute regnet es in der Stadt, und die Züge sind spät.
Mein Bruder kocht am Sonntag Suppe für die ganze Familie.
Das Museum hat nur bis sechs Uhr offen, danach gehen wir essen.
Wer kommt morgen mit auf den Berg?
Ich habe zwei Karten für das Konzert gekauft, aber sie kann nicht.
Il pleut sur la ville et les trains sont en retard.
Ma sœur prépare une soupe pour toute la famille le dimanche.
Le musée ferme à six heures, puis nous allons dîner.
Qui vient avec nous à la montagne demain ?
J'ai acheté deux billets pour le concert, mais il ne peut pas venir.
Hoy llueve en la ciudad y los trenes llegan tarde.
Mi hermano cocina una sopa para toda la familia los domingos.
El museo cierra a las seis, después vamos a cenar.
¿Quién viene con nosotros a la montaña mañana?
He comprado dos entradas para el concierto, pero ella no puede.
print("hello, world")
if (x > 0) { return x * 2; } else { return -1; }
SELECT count(*) FROM orders WHERE total > 10
Letters go to 5 Station Road, or call 020 7946 0018 before noon.
Ask for Clara Jensen or write to clara at mail dot example.
Her passport C0123456 and her bank card were found in the park.
The old couple, Otto and Frida Brandt, lived at 9 Hill Lane.
One plus one is two, and 3 * 5 is 15.
"""
