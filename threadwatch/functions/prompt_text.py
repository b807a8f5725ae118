"""Prompt templates (fixed values).

Placeholders use ``str.format`` syntax; ``operators.prompts.render`` turns a
template into one ``concat`` expression over columns.
"""

# --- fixed values: prompt templates, verbatim ------------------------------

TOPIC_PROMPT = "\nSei un annotatore esperto nella classificazione tematica di articoli di notizie in italiano.\n\nIl tuo compito è assegnare all'ARTICOLO UNA SOLA categoria tematica, scegliendola esclusivamente dalla lista di categorie qui sotto.\n\nCATEGORIE DISPONIBILI\n\nScegli una sola tra le seguenti categorie. Tra parentesi sono riportati alcuni esempi di sottotemi che appartengono a quella categoria: servono solo a chiarire cosa copre la categoria e NON sono opzioni di risposta valide.\n\n{taxonomy}\n\nTASK DI ANNOTAZIONE\n\nLeggi attentamente il titolo e la descrizione dell'articolo, individua il tema principale e assegna la categoria più pertinente tra quelle elencate sopra.\n\nISTRUZIONI IMPORTANTI\n\n- Considera l'articolo nel suo complesso e identifica il suo argomento PRINCIPALE.\n- Scegli una sola categoria, quella che meglio rappresenta il contenuto.\n- Rispondi ESCLUSIVAMENTE con il nome ESATTO di una categoria, copiato letteralmente dalla lista (senza gli esempi tra parentesi).\n- Non inventare nuove categorie e non rispondere con i sottotemi tra parentesi.\n- Non fornire spiegazioni, punteggiatura extra o testo aggiuntivo.\n\nFORMATO INPUT\n\nARTICLE TITLE:\n{article_title}\n\nARTICLE DESCRIPTION:\n{article_description}\n\nFORMATO OUTPUT\n\nRestituisci SOLO il nome di una categoria dalla lista, ad esempio:\n\npolitics and government\n"

COMMENT_PROMPT = '\nSei un annotatore esperto nel riconoscimento di linguaggio offensivo nei commenti online in italiano.\n\nIl tuo compito è determinare se il COMMENTO TARGET potrebbe ragionevolmente essere considerato offensivo da qualcuno.\n\nDevi annotare SOLO il COMMENTO TARGET, utilizzando eventuali informazioni contestuali esclusivamente per interpretarne meglio significato, tono, riferimenti e intenzione comunicativa.\n\nDEFINIZIONE\n\nUn commento è considerato offensivo se contiene linguaggio volgare, insultante, aggressivo, denigratorio, discriminatorio, minaccioso o gravemente irrispettoso, in modo esplicito o implicito, verso una persona o un gruppo.\n\nIl criterio centrale è l’offensività potenziale:\nnon devi valutare se il commento offende te personalmente, ma se qualcuno potrebbe ragionevolmente percepirlo come offensivo.\n\nTASK DI ANNOTAZIONE\n\nLeggi attentamente tutto il contesto disponibile.\n\nPoi rispondi alla seguente domanda:\n\n"Questo COMMENTO TARGET potrebbe ragionevolmente essere considerato offensivo da qualcuno?"\n\nRestituisci SOLO una delle seguenti etichette:\n\n- Sì\n- No\n\nNon fornire spiegazioni o testo aggiuntivo.\n\nISTRUZIONI IMPORTANTI\n\n- Annota SOLO il COMMENTO TARGET.\n- Usa il titolo e la descrizione del video esclusivamente per comprendere il tema, il contesto e i riferimenti del commento.\n- Usa eventuali commenti precedenti esclusivamente per comprendere tono, sarcasmo, riferimenti, bersagli o intenzioni.\n- Non annotare il titolo del video, la descrizione o i commenti precedenti.\n- Considera sia l’offensività esplicita sia quella implicita.\n- Valuta insieme tono, intenzione, linguaggio e contesto conversazionale.\n- Se un commento contiene sarcasmo, ironia, derisione o ostilità implicita che potrebbe ragionevolmente risultare offensiva, etichettalo come offensivo.\n- In caso di dubbio, considera l’effetto complessivo del messaggio piuttosto che singole parole isolate.\n- In caso di dubbio, preferisci "Sì" se una persona ragionevole potrebbe percepire il commento come offensivo.\n\nETICHETTA "Sì" SE IL COMMENTO TARGET:\n\n- Contiene insulti, parolacce, epiteti o linguaggio denigratorio\n- Attacca, umilia, deride o svaluta una persona o un gruppo\n- Usa linguaggio volgare con intento aggressivo o ostile\n- Esprime odio, disprezzo o forte mancanza di rispetto\n- Colpisce etnia, nazionalità, genere, religione, orientamento sessuale, disabilità, appartenenza politica o caratteristiche simili\n- Contiene minacce, intimidazioni o auguri di danno\n- Usa sarcasmo o ironia con effetto offensivo\n- Potrebbe essere percepito come offensivo da almeno una persona ragionevole\n\nETICHETTA "No" SE IL COMMENTO TARGET:\n\n- Esprime disaccordo o critica in modo rispettoso\n- Usa linguaggio informale o colloquiale senza aggressività\n- Discute temi sensibili in modo neutro o analitico\n- Riporta termini offensivi senza approvarli\n- Contiene espressioni emotive leggere senza intento offensivo\n- È solo vagamente scortese o ambiguo senza offensività chiara\n\nGESTIONE DEL CONTESTO\n\nL’input può contenere:\n\n- VIDEO TITLE: titolo del video\n- VIDEO DESCRIPTION: descrizione del video\n- HEAD COMMENT: commento principale della conversazione\n- PREVIOUS COMMENT: commento immediatamente precedente\n- TARGET COMMENT: commento da annotare\n\nAlcuni campi possono essere vuoti se non disponibili.\n\nRegole:\n\n- Usa il contesto solo per interpretare correttamente il COMMENTO TARGET.\n- Un commento apparentemente neutro può diventare offensivo nel contesto della conversazione.\n- Una parola apparentemente offensiva può essere neutra a seconda del contesto.\n- L’etichetta finale deve riferirsi esclusivamente al COMMENTO TARGET.\n\nFORMATO INPUT\n\nVIDEO TITLE:\n{video_title}\n\nVIDEO DESCRIPTION:\n{video_description}\n\nHEAD COMMENT:\n{head_comment}\n\nPREVIOUS COMMENT:\n{previous_comment}\n\nTARGET COMMENT:\n{target_comment}\n\nFORMATO OUTPUT\n\nRestituisci SOLO:\n\nSì\n\noppure\n\nNo\n'

RISK_PROMPTS = [
    'Sei un sistema automatico di moderazione di una piattaforma di notizie online.\n\nDato il titolo e la descrizione di un video, devi prevedere se la discussione generata attirerà una quantità significativa di commenti offensivi.\n\nPer commenti offensivi si intendono insulti, aggressioni verbali, linguaggio d\'odio, discriminazione, denigrazione o attacchi verso persone o gruppi.\n\nTITOLO:\n{video_title}\n\nDESCRIZIONE:\n{video_description}\n\nQuesto video attirerà una quantità significativa di commenti offensivi?\n\nRispondi esclusivamente con una sola parola:\n"Sì" oppure "No".\n',
    'Sei un esperto di moderazione di contenuti online in italiano.\n\nDEFINIZIONE: un commento è offensivo se contiene linguaggio volgare, insultante, aggressivo, denigratorio, discriminatorio o minaccioso verso una persona o un gruppo.\n\nCOMPITO: leggendo SOLO il titolo e la descrizione di un video di notizie, prevedi se il video attirerà un numero rilevante di commenti offensivi da parte degli utenti.\n\nTITOLO:\n{video_title}\n\nDESCRIZIONE:\n{video_description}\n\nConsidera quanto l\'argomento è delicato, divisivo o emotivamente carico.\n\nRispondi solo con "Sì" (attirerà commenti offensivi) oppure "No" (non li attirerà). Nessun\'altra parola.\n',
    'Immagina la sezione commenti di questo video di notizie.\n\nTITOLO:\n{video_title}\n\nDESCRIZIONE:\n{video_description}\n\nValuta se è probabile che la discussione contenga numerosi commenti offensivi, aggressivi, denigratori o ostili verso persone, gruppi o istituzioni.\n\nNon considerare la semplice presenza occasionale di qualche insulto: valuta se l\'offensività sarà una componente rilevante della discussione.\n\nRispondi esclusivamente con:\n"Sì" oppure "No".\n',
    'Sei un moderatore professionista di contenuti online.\n\nIl tuo compito è prevedere se un video di notizie genererà una discussione con una quantità rilevante di commenti offensivi.\n\nValuta mentalmente:\n- il livello di conflittualità del tema;\n- il potenziale di indignazione pubblica;\n- la presenza di gruppi frequentemente bersaglio di ostilità;\n- la probabilità di scontri verbali tra utenti.\n\nTITOLO:\n{video_title}\n\nDESCRIZIONE:\n{video_description}\n\nRispondi soltanto con:\n"Sì" oppure "No".',
    'Sei un sistema di previsione del rischio di offensività nelle discussioni online.\n\nUtilizzando esclusivamente il titolo e la descrizione del video, stima se la conversazione che seguirà presenterà un livello elevato di commenti offensivi.\n\nPer livello elevato si intende una presenza consistente di:\n- insulti;\n- aggressività verbale;\n- linguaggio d\'odio;\n- discriminazione;\n- attacchi personali o verso gruppi sociali.\n\nTITOLO:\n{video_title}\n\nDESCRIZIONE:\n{video_description}\n\nOutput consentito:\n"Sì"\noppure\n"No"\n',
]
# --- end of fixed values ----------------------------------------------------
